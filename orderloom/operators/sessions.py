"""Sessions: a key's events that follow each other within a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Seconds of a bucket within which a key's events are joined first.
BUCKET = 86_400


def sessions(events: DataFrame, key: str, time: str, gap: int, sums: dict[str, Column] | None = None, bucket: int = BUCKET) -> DataFrame:
    """(key, started, ended, events, sums...): sessions of a batch; an event within ``gap`` seconds of the one before belongs to its session.

    A key's events are first joined to sessions within buckets of time, so that a hot key is spread over tasks; what is then
    joined along each key are the few sessions of its buckets. Events without key or time have no session.
    """
    sums = sums or {}
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(time).cast("timestamp").alias("_at"), *[c.alias(n) for n, c in sums.items()])
    micros = F.unix_micros("_at")
    rows = rows.withColumns({"_us": micros, "_bucket": F.floor(micros / (bucket * 1_000_000))})
    parts = _joined(rows.select("_key", "_bucket", F.col("_us").alias("a"), F.col("_us").alias("b"), F.lit(1).cast("long").alias("n"), *sums), ["_key", "_bucket"], gap, list(sums))
    whole = _joined(parts.drop("_bucket"), ["_key"], gap, list(sums))
    return whole.select(F.col("_key").alias(key), F.timestamp_micros("a").alias("started"), F.timestamp_micros("b").alias("ended"), F.col("n").alias("events"), *sums)


def _joined(rows: DataFrame, keys: list[str], gap: int, sums: list[str]) -> DataFrame:
    """Spans (a, b) of each key that lie within the gap of what came before are one."""
    order = W.partitionBy(*keys).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(F.col("a") - before <= gap * 1_000_000, 0).otherwise(1)
    marked = rows.withColumn("_new", starts).withColumn("_session", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*keys, "_session").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]).drop("_session")


def session_stream(events: DataFrame, key: str, time: str, gap: int, watermark: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """The same on a stream, each session once the watermark has passed its end; an event that is late but on
    time joins sessions that were apart. Spark's window takes an event at the gap's very end for the next session,
    so the gap is a microsecond longer."""
    rows = events.where(F.col(key).isNotNull()).withWatermark(time, watermark)
    span = F.session_window(time, f"{gap * 1_000_000 + 1} microseconds")
    own = rows.groupBy(span.alias("_span"), key).agg(F.count("*").alias("events"), F.max(time).alias("ended"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()])
    return own.select(key, F.col("_span.start").alias("started"), "ended", "events", *(sums or {}))
