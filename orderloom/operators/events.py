"""From messages to trusted orders. All functions take batch and streaming frames alike, dedup aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..contracts import EVENT
from ..functions.columns import amount, domain, instant
from . import rules


def envelope(messages: DataFrame) -> DataFrame:
    """The raw layer's columns: the message as it came, and when."""
    now = F.current_timestamp()
    return messages.select(
        F.col("key").cast("string").alias("kafkaKey"), F.col("value").cast("string").alias("payload"), F.col("topic").alias("kafkaTopic"),
        F.col("partition").alias("kafkaPartition"), F.col("offset").alias("kafkaOffset"), F.col("timestamp").alias("kafkaTimestamp"),
        now.alias("ingestedAt"), F.to_date(now).alias("ingestionDate"),
    )


def decode(df: DataFrame, payload: str | Column = "payload", keep: tuple[Column, ...] = ()) -> DataFrame:
    """The event's fields with occurredAt as an instant, beside the columns ``keep``."""
    source = F.col(payload) if isinstance(payload, str) else payload
    parsed = df.select(F.from_json(source.cast("string"), EVENT).alias("event"), *keep)
    rest = [c for c in parsed.columns if c != "event"]
    return parsed.select("event.*", *rest).withColumn("occurredAt", instant("occurredAt"))


def parsed_events(messages: DataFrame) -> DataFrame:
    """What the live metrics read."""
    return rules.valid(rules.computed(decode(messages, "value")), rules.PARSED)


def refined(raw: DataFrame) -> DataFrame:
    """Decoded and normalised orders with derived columns, before any rule."""
    keep = tuple(F.col(c) for c in ("kafkaTopic", "kafkaPartition", "kafkaOffset", "kafkaTimestamp")) + (F.col("ingestedAt").alias("bronzeIngestedAt"),)
    return decode(raw, keep=keep).withColumns(
        {"channel": domain("channel"), "location": domain("location"), "revenue": amount("quantity", "unitPrice"), "eventDate": F.to_date("occurredAt"), "silverProcessedAt": F.current_timestamp()}
    )


def trusted_orders(raw: DataFrame) -> DataFrame:
    """Valid orders, not yet deduplicated: an invalid copy must not shadow a valid one."""
    return rules.valid(rules.computed(refined(raw)), rules.COMPUTABLE)


def reject_orders(raw: DataFrame) -> DataFrame:
    """Raw records that the trusted layer leaves out, with the reasons."""
    return rules.rejected(refined(raw), rules.COMPUTABLE)


def first_of_each(df: DataFrame, key: str | list[str], *order: str | Column) -> DataFrame:
    """The first row of each key under a total order; deterministic, for batches."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def first_on_stream(df: DataFrame, key: str = "eventId", time: str = "occurredAt", watermark: str = "10 minutes", bounded: bool = False) -> DataFrame:
    """The first row of each key on a stream; rows behind the watermark are dropped.

    Unbounded, a key is remembered for good. Bounded, for the watermark's length only: a copy that
    comes after that is passed again.
    """
    marked = df.withWatermark(time, watermark)
    return marked.dropDuplicatesWithinWatermark([key]) if bounded else marked.dropDuplicates([key])
