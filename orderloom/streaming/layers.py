"""Continuous queries: raw and trusted layers, live metrics, delivery. Each has its own checkpoint."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import events, metrics, rules
from ..operators.delivery import CONSUMED, PROCESSED, PROJECTED, as_dead, consumed, dead_letters, retried
from ..settings import Settings
from ..sources.files import exists, file_system, messages, raw_stream, wait_for


def _started(writer, name: str, checkpoint: str, available_now: bool):
    writer = writer.queryName(name).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer


def raw_layer(spark: SparkSession, settings: Settings, available_now: bool = False) -> StreamingQuery:
    """All messages, unchanged, by the day they came."""
    writer = events.envelope(messages(spark, settings)).writeStream.format("parquet").outputMode("append").partitionBy("ingestionDate").option("path", settings.raw)
    return _started(writer, "raw_layer", settings.checkpoint("raw"), available_now).start()


def trusted_layer(spark: SparkSession, settings: Settings, available_now: bool = False) -> StreamingQuery:
    """Valid orders, each once, by the day they happened; waits for the raw layer."""
    wait_for(spark, settings.raw, settings.wait_seconds, settings.poll_seconds)
    orders = events.first_on_stream(events.trusted_orders(raw_stream(spark, settings)), watermark=settings.dedup_watermark, bounded=settings.bounded_dedup)
    writer = orders.writeStream.format("parquet").outputMode("append").partitionBy("eventDate").option("path", settings.trusted)
    return _started(writer, "trusted_layer", settings.checkpoint("trusted"), available_now).start()


def live_stream(source: DataFrame, settings: Settings) -> DataFrame:
    """Changed windows with their new totals (update mode)."""
    marked = events.parsed_events(source).withWatermark("occurredAt", settings.live_watermark)
    return metrics.flat_window(metrics.live(marked, settings.live_window))


#: Values of the hash by which a failing batch is halved.
SPLITS = 1 << 62
KEYS = ("window_start", "window_end", "channel")


def upsert(batch: DataFrame, batch_id: int, path: str) -> None:
    """Keeps each window's latest totals. Batches write their own folder, so a repeated batch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")


def live_totals(spark: SparkSession, path: str) -> DataFrame:
    """The latest totals of each window and channel from what upsert() kept."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*KEYS, "batch")]
    latest = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*KEYS, "v.*")


def compact_live(spark: SparkSession, path: str) -> None:
    """Folds the micro-batches' folders into one; for when the query is stopped.

    The folded totals get the last batch's number, negative, which readers rank below any batch. They appear
    whole before anything is deleted, older folds go first, and a repeated call ends what one that crashed began.
    """
    fs, root = file_system(spark, path)
    numbers = sorted(int(x.partition("=")[2]) for f in fs.listStatus(root) if (x := f.getPath().getName()).startswith("batch="))
    batches, folds = [n for n in numbers if n >= 0], [n for n in numbers if n < 0]
    if not batches:
        return
    name = lambda n: f"batch={n:012d}" if n >= 0 else f"batch=-{-n:012d}"
    fold = -batches[-1] - 1
    if fold not in folds:
        staged = f"{path}/_compact-{uuid.uuid4().hex}"
        live_totals(spark, path).write.parquet(staged)
        fs.rename(file_system(spark, staged)[1], file_system(spark, f"{path}/{name(fold)}")[1])
    for n in [x for x in folds if x != fold] + batches:
        fs.delete(file_system(spark, f"{path}/{name(n)}")[1], True)


def live_metrics(spark: SparkSession, settings: Settings, available_now: bool = False, console: bool = False) -> StreamingQuery:
    stream = live_stream(messages(spark, settings), settings)
    writer = stream.writeStream.outputMode("update")
    path = settings.at("live")
    writer = writer.format("console").option("truncate", "false") if console else writer.foreachBatch(lambda df, i: upsert(df, i, path))
    return _started(writer, "live_metrics", settings.checkpoint("live"), available_now).start()


def _received(spark: SparkSession, settings: Settings) -> DataFrame:
    keep = tuple(F.col(c) for c in ("kafkaKey", "kafkaPartition", "kafkaOffset", "payload"))
    return events.decode(events.envelope(messages(spark, settings)), keep=keep)


def _consumed(df: DataFrame, name: str, settings: Settings) -> None:
    """Projection and processed ids by one write, which replaces that of a repeated batch or part."""
    consumed(df).write.mode("overwrite").parquet(f"{settings.at('consumed')}/batch={name}")


def _all_consumed(spark: SparkSession, settings: Settings) -> DataFrame:
    """What was consumed so far; no rows before the first batch."""
    if not exists(spark, settings.at("consumed")):
        return spark.createDataFrame([], CONSUMED)
    return spark.read.schema(CONSUMED).parquet(settings.at("consumed"))


def projection(spark: SparkSession, settings: Settings) -> DataFrame:
    return _all_consumed(spark, settings).select(*PROJECTED)


def processed(spark: SparkSession, settings: Settings) -> DataFrame:
    return _all_consumed(spark, settings).select(*PROCESSED)


def _failing(df: DataFrame, save: Callable[[DataFrame, str], None], settings: Settings, low: int = 0, high: int = SPLITS) -> list[tuple[int, int, str]]:
    """Saves what can be saved of the records whose hash lies in [low, high), and returns the ranges of single records that can't, with the error.

    A range that fails is halved, down to one record; the whole batch and single records are tried again after a pause.
    """
    part = df.where((F.col("_at") >= low) & (F.col("_at") < high))
    n = len(part.select("_at").limit(2).collect())
    if not n:
        return []
    single = n == 1 or high - low == 1
    try:
        retried(lambda: save(part.drop("_at"), f"{low}-{high}"), settings.consumer_retries if single or high - low == SPLITS else 0, settings.consumer_pause)
        return []
    except Exception as e:  # noqa: BLE001  kept with the records
        if single:
            return [(low, high, f"{type(e).__name__}: {e}"[: settings.error_chars])]
    middle, out = (low + high) // 2, []
    for a, b in ((low, middle), (middle, high)):
        out += _failing(df, save, settings, a, b)
        if len(out) > settings.consumer_dead:
            raise TooManyFailures(f"more than {settings.consumer_dead} records of a batch can't be saved: {out[-1][2]}")
    return out


class TooManyFailures(RuntimeError):
    """So many records fail that the store is to blame, and not they."""


def consumer(spark: SparkSession, settings: Settings, available_now: bool = False, save: Callable[[DataFrame, str, Settings], None] = _consumed) -> StreamingQuery:
    """Projects each event once. The ids that were consumed are the query's state (on disk), so a batch
    costs what it holds and not what came before.

    A batch that can't be saved is tried again after a pause, twice; then it is halved by the hash of its ids until the records that fail are
    known, each of which is tried again, too. These go under the dead-letter topic with the error as their reason, and all
    others are projected. Where more than ``consumer_dead`` fail, or the dead letters can't be written, the query fails and starts again with
    that batch. ``save`` gets rows and a name, and replaces what it wrote under that name before.
    """
    fresh = rules.valid(_received(spark, settings), rules.PROJECTION).dropDuplicates(["eventId"])

    def step(df: DataFrame, batch_id: int) -> None:
        fs, left = file_system(spark, f"{settings.at('consumed')}/batch={batch_id}")
        fs.delete(left, True)  # what an attempt that crashed has saved
        rows = df.withColumn("_at", F.pmod(F.xxhash64("eventId"), F.lit(SPLITS))).persist()
        try:
            bad = _failing(rows, lambda part, name: save(part, f"{batch_id}/part={name}", settings), settings)
            if bad:
                known = F.broadcast(spark.createDataFrame(bad, "_low long, _high long, _reason string"))  # at most consumer_dead
                lost = rows.join(known, (F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high")))
                as_dead(lost.withColumn("reasons", F.array("_reason")), settings.topic).write.mode("overwrite").json(f"{settings.at('dead', f'{settings.topic}.DLT')}/batch={batch_id}")
        finally:
            rows.unpersist()

    return _started(fresh.writeStream.foreachBatch(step), "consumer", settings.checkpoint("consumer"), available_now).start()


def dead_letter_queue(spark: SparkSession, settings: Settings, available_now: bool = False) -> StreamingQuery:
    """Puts what can't be projected under the dead-letter topic, with the reasons."""
    dead = dead_letters(_received(spark, settings), settings.topic)
    writer = dead.writeStream.format("json").outputMode("append").option("path", settings.at("topic", f"{settings.topic}.DLT"))
    return _started(writer, "dead_letter_queue", settings.checkpoint("dead_letters"), available_now).start()


def run_all(spark: SparkSession, settings: Settings, poll: float = 1.0) -> None:
    """The raw layer and the live metrics side by side; when either ends or fails, the other is stopped,
    and a failure is raised."""
    both = [raw_layer(spark, settings), live_metrics(spark, settings)]
    try:
        while all(q.isActive for q in both):
            time.sleep(poll)
    finally:
        for q in both:
            q.stop()
    for q in both:
        if q.exception() is not None:
            raise q.exception()
