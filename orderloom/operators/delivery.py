"""Delivery semantics as set operations: idempotent acceptance, an outbox, consume-once, dead letters.

At least once, with idempotent effects: repeating any step with the same input changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..contracts import struct
from . import rules
from .events import first_of_each

PENDING, PUBLISHED = "PENDING", "PUBLISHED"
# Fixed values of accepted events.
EVENT_TYPE, EVENT_VERSION, AGGREGATE = "ORDER_CREATED", 1, "ORDER"
PRODUCER = "order-intake"


def accept(requests: DataFrame, known: DataFrame, *order: str | Column) -> DataFrame:
    """One row for each request (idempotencyKey, eventId, createdAt, payloadHash): what it is answered.

    The first request of a key is accepted unless the key is known; all others replay the stored
    eventId and createdAt. Of requests that are equal in all of the order's columns, one is the first.
    Payloads aren't compared for that, but a differing one is marked. A request without a key replays
    nothing: it is answered with its own event. known: (idempotencyKey, eventId, createdAt, payloadHash).
    """
    order = order or ("createdAt", "eventId")
    stored = known.where("idempotencyKey is not null").select("idempotencyKey", F.col("eventId").alias("_e"), F.col("createdAt").alias("_c"), F.col("payloadHash").alias("_h"))
    keyed = requests.where("idempotencyKey is not null")
    # requests without a key are answered on their own, so they needn't meet
    plain = requests.where("idempotencyKey is null").withColumns({"answeredId": F.col("eventId"), "answeredAt": F.col("createdAt"), "replayed": F.lit(False), "payloadConflict": F.lit(False)})
    same = W.partitionBy("idempotencyKey").orderBy(*order)
    first = {f"_f{i}": F.first_value(c).over(same) for i, c in enumerate(("eventId", "createdAt", "payloadHash"))}
    rows = keyed.withColumns(first | {"_nth": F.row_number().over(same)}).join(stored, "idempotencyKey", "left")
    replayed = F.col("_e").isNotNull() | (F.col("_nth") > 1)
    conflict = replayed & ~F.col("payloadHash").eqNullSafe(F.when(F.col("_e").isNotNull(), F.col("_h")).otherwise(F.col("_f2")))
    out = rows.withColumns({"answeredId": F.coalesce("_e", "_f0"), "answeredAt": F.coalesce("_c", "_f1"), "replayed": replayed, "payloadConflict": conflict})
    return out.drop("_e", "_c", "_h", "_f0", "_f1", "_f2", "_nth").unionByName(plain)


def accepted(answers: DataFrame) -> DataFrame:
    """The requests that create events, once each."""
    return answers.where(~F.col("replayed"))


def outbox_entries(created: DataFrame, *keep: str) -> DataFrame:
    """Pending outbox rows for accepted requests (eventId, createdAt, payload), beside the columns ``keep``."""
    return created.select(
        F.col("eventId").alias("id"), F.lit(AGGREGATE).alias("aggregateType"), F.col("eventId").alias("aggregateId"), F.lit(EVENT_TYPE).alias("eventType"), "payload",
        F.lit(PENDING).alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("lastError"), "createdAt", F.lit(None).cast("timestamp").alias("publishedAt"), *keep,
    )


def next_batch(outbox: DataFrame, size: int = 50) -> DataFrame:
    """The oldest pending entries; the id breaks ties, so the page is the same each time."""
    return outbox.where(F.col("status") == PENDING).orderBy("createdAt", "id").limit(size)


def settle(outbox: DataFrame, results: DataFrame, error_chars: int = 2000) -> DataFrame:
    """The outbox after results (id, error): null error publishes, any other stays pending with one more attempt."""
    joined = outbox.join(results.select("id", F.lit(True).alias("_tried"), F.col("error").alias("_error")), "id", "left")
    sent = F.col("_tried") & F.col("_error").isNull()
    failed = F.col("_tried") & F.col("_error").isNotNull()
    return joined.withColumns({
        "status": F.when(sent, F.lit(PUBLISHED)).otherwise(F.col("status")),
        "attempts": F.col("attempts") + F.when(failed, 1).otherwise(0),
        "lastError": F.when(sent, F.lit(None).cast("string")).when(failed, F.substring("_error", 1, error_chars)).otherwise(F.col("lastError")),
        "publishedAt": F.when(sent, F.current_timestamp()).otherwise(F.col("publishedAt")),
    }).drop("_tried", "_error")


def tried(outbox: DataFrame, results: DataFrame, error_chars: int = 2000, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """The outbox under a log of results (id, error, triedAt): one without error publishes, each other is an attempt. ``by`` names the columns that both share."""
    sent = F.col("error").isNull()
    each = results.groupBy(*by).agg(
        F.bool_or(sent).alias("_sent"), F.count_if(~sent).cast("int").alias("_failed"), F.max_by(F.when(~sent, F.struct("error")), F.when(~sent, F.col("triedAt"))).alias("_last"), F.min(F.when(sent, F.col("triedAt"))).alias("_at")
    )
    joined = outbox.join(each, list(by), "left")
    done = F.coalesce("_sent", F.lit(False))
    return joined.withColumns({
        "status": F.when(done, F.lit(PUBLISHED)).otherwise(F.col("status")),
        "attempts": F.col("attempts") + F.coalesce("_failed", F.lit(0)),
        "lastError": F.when(done, F.lit(None).cast("string")).when(F.col("_last").isNotNull(), F.substring("_last.error", 1, error_chars)).otherwise(F.col("lastError")),
        "publishedAt": F.coalesce("_at", "publishedAt"),
    }).drop("_sent", "_failed", "_last", "_at")


def retried(run: Callable[[], None], retries: int = 2, pause: float = 1.0, final: tuple[type[Exception], ...] = (ValueError,)) -> None:
    """Runs again after a failure, at most ``retries`` times; ``final`` errors aren't tried again."""
    for attempt in range(retries + 1):
        try:
            return run()
        except final:
            raise
        except Exception:
            if attempt == retries:
                raise
            time.sleep(pause)


def consume(events: DataFrame, processed: DataFrame, *order: str | Column) -> DataFrame:
    """Events whose eventId was not processed before, each once."""
    fresh = events.join(processed.select("eventId"), "eventId", "left_anti")
    return first_of_each(fresh, "eventId", *(order or ("occurredAt",)))


PROJECTED = ("eventId", "customerId", "productId", "quantity", "unitPrice", "channel", "location", "occurredAt", "processedAt")
PROCESSED = ("eventId", "eventType", "processedAt")
CONSUMED = struct("eventId string, customerId string, productId string, quantity int, unitPrice decimal(19,2), channel string, location string, occurredAt timestamp, processedAt timestamp, eventType string")


def consumed(events: DataFrame) -> DataFrame:
    """What is kept of consumed events: one row has the columns of the projection and of the processed ids,
    so that both are written by one commit."""
    return events.withColumn("processedAt", F.current_timestamp()).select(*dict.fromkeys(PROJECTED + PROCESSED))


def projections(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projection, processed) rows of consumed events."""
    rows = consumed(events)
    return rows.select(*PROJECTED), rows.select(*PROCESSED)


def dead_letters(df: DataFrame, topic: str, broken: tuple[rules.Rule, ...] = rules.PROJECTION) -> DataFrame:
    """Records that break the projection's rules, under the dead-letter topic and on their own partition."""
    return as_dead(rules.rejected(df, broken), topic)


def as_dead(bad: DataFrame, topic: str) -> DataFrame:
    """Records with ``reasons`` as messages of the dead-letter topic."""
    return bad.select(F.lit(f"{topic}.DLT").alias("topic"), F.col("kafkaPartition").alias("partition"), F.col("kafkaKey").alias("key"), F.col("payload").alias("value"), "reasons")


def find(projection: DataFrame, event_id: str) -> dict:
    """One order by its id, or NotFound."""
    row = projection.where(F.col("eventId") == F.lit(event_id)).first()
    if row is None:
        raise NotFound(f"no order {event_id}")
    return row.asDict()


class NotFound(LookupError):
    pass
