"""Publishing the outbox: the oldest pending entries are sent, then marked; what fails stays pending."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import PUBLISHED, accept, accepted, next_batch, outbox_entries, retried, tried
from ..settings import Settings
from ..sources.versions import Conflict, Snapshot, VersionedTable


def as_messages(batch: DataFrame) -> DataFrame:
    """Keyed by the aggregate, so that events of one order keep their order."""
    return batch.select(F.col("aggregateId").cast("binary").alias("key"), F.col("payload").cast("binary").alias("value"))


def send(batch: DataFrame, settings: Settings) -> None:
    """To the Kafka topic, or as files of messages below the root."""
    rows = as_messages(batch)
    if settings.source_format == "kafka":
        ms = int(settings.send_seconds * 1000)
        limits = {"kafka.delivery.timeout.ms": str(ms), "kafka.request.timeout.ms": str(ms * 4 // 5), "kafka.linger.ms": "0", "kafka.max.block.ms": str(ms)}
        rows.write.format("kafka").option("kafka.bootstrap.servers", settings.kafka_servers).option("kafka.acks", "all").option("topic", settings.topic).options(**limits).save()
        return
    stamp = rows.withColumns({"topic": F.lit(settings.topic), "partition": F.pmod(F.xxhash64("key"), F.lit(3)).cast("int"), "offset": F.monotonically_increasing_id(), "timestamp": F.current_timestamp()})
    stamp.write.mode("append").format(settings.source_format).save(settings.at("topic", settings.topic))


#: An entry's requests: the idempotency key it answers and the hash of its payload.
KEYS = ("idempotencyKey", "payloadHash")


class Outbox:
    """Entries, results and history. Producers append entries, the publisher appends results, so they can't undo each other's work.

    ``settle`` moves published entries to the history, folds failures into the entries that stay, and empties the results. Entries have
    an ``epoch`` that each settling raises, and a result counts for the entry of its epoch alone, so a crash between these steps
    counts nothing twice. A step of the publisher therefore reads what is pending or was tried since, and never the history.
    """

    def __init__(self, spark: SparkSession, path: str, error_chars: int = 2000):
        self.spark, self.error_chars = spark, error_chars
        self.entries, self.results, self.history = (VersionedTable(spark, f"{path.rstrip('/')}/{x}", day_of=None) for x in ("entries", "results", "history"))

    def _shaped(self, entries: DataFrame) -> DataFrame:
        """With the columns that outbox_entries() leaves out; entries that no request asked for have no key."""
        more = {c: F.lit(None).cast(t) for c, t in zip(KEYS, ("string", "long")) if c not in entries.columns}
        return entries.withColumns(more | {"epoch": F.lit(0)})

    def add(self, entries: DataFrame, expected: Snapshot | None = None) -> None:
        """Rows of outbox_entries(), with idempotencyKey and payloadHash where they have them, in one commit."""
        rows = self._shaped(entries)
        self.entries.append(rows, expected=expected) if self.entries.exists() else self.entries.create(rows)

    def waiting(self) -> DataFrame:
        """Entries that aren't in the history yet, with their present status."""
        rows = self.entries.read()
        return tried(rows, self.results.read(), self.error_chars, ("id", "epoch")) if self.results.exists() else rows

    def read(self) -> DataFrame:
        """All entries with their present status."""
        rows = self.waiting().drop("epoch", *KEYS)
        if not self.history.exists():
            return rows
        done = self.history.read().drop(*KEYS)
        done = done.groupBy("id").agg(F.min_by(F.struct(*[c for c in done.columns if c != "id"]), "publishedAt").alias("v")).select("id", "v.*")
        return done.unionByName(rows.join(done.select("id"), "id", "left_anti"))

    def keys(self) -> DataFrame:
        """(idempotencyKey, eventId, createdAt, payloadHash) of all requests that were accepted."""
        facts = ("idempotencyKey", F.col("id").alias("eventId"), "createdAt", "payloadHash")
        rows = self.entries.read().where("idempotencyKey is not null").select(*facts)
        return rows.unionByName(self.history.read().where("idempotencyKey is not null").select(*facts)).distinct() if self.history.exists() else rows

    def note(self, results: DataFrame) -> None:
        self.results.append(results) if self.results.exists() else self.results.create(results)

    def settle(self) -> bool:
        """Moves what is published to the history; False if a producer came between, for then it waits for the next time."""
        if not self.results.exists():
            return False
        seen = self.entries.current()
        now = self.waiting()
        done = now.where(F.col("status") == PUBLISHED).drop("epoch")
        self.history.append(done) if self.history.exists() else self.history.create(done)
        try:
            self.entries.overwrite(now.where(F.col("status") != PUBLISHED).withColumn("epoch", F.col("epoch") + 1), seen)
        except Conflict:
            return False  # the history has some entries twice, which read() takes for one
        self.results.overwrite(self.results.read().limit(0))
        for t in (self.entries, self.results):
            t.expire(2)
        return True

    def compact(self, keep: int = 2) -> None:
        """Small folders into one each; older snapshots go."""
        for t in (self.entries, self.results, self.history):
            if t.exists():
                t.compact()
                t.expire(keep)


def intake(store: Outbox, requests: DataFrame, tries: int = 5) -> DataFrame:
    """Answers requests (idempotencyKey, eventId, createdAt, payloadHash, payload), and stores those that are accepted: one commit holds
    their keys and their outbox entries, so a crash leaves both or neither. If another intake commits first, requests are answered anew.
    The answers are those that were stored."""
    for left in reversed(range(tries)):
        if not store.entries.exists():
            answers = accept(requests, requests.limit(0))
            seen = None
        else:
            seen = store.entries.current()
            answers = accept(requests, store.keys())
        answers = answers.persist()
        rows = outbox_entries(accepted(answers), *KEYS)
        try:
            store.add(rows, seen)
            return answers
        except Conflict:
            answers.unpersist()
            if not left:
                raise
    raise ValueError("tries must be at least 1")


class _Down(Exception):
    """Nothing gets through."""


def _sent(batch: DataFrame, ids: list[str], settings: Settings, sender: Callable[[DataFrame, Settings], None], got: dict[str, str | None]) -> None:
    """Notes the error of each id in ``got``, None if it was sent. A batch that fails is halved until it is clear which entries
    fail; where the first ``outbox_give_up`` fail one by one and none was sent, the broker is taken to be down."""
    try:
        retried(lambda: sender(batch.where(F.col("id").isin(ids)).orderBy("createdAt", "id"), settings), settings.consumer_retries if len(ids) == 1 else 0, 0.0)
        got |= dict.fromkeys(ids)
        return
    except Exception as e:  # noqa: BLE001  kept with the entries
        if len(ids) == 1:
            got[ids[0]] = f"{type(e).__name__}: {e}"[: settings.error_chars]
            if len(got) >= settings.outbox_give_up and all(got.values()):
                raise _Down from e
            return
    half = len(ids) // 2
    for part in (ids[:half], ids[half:]):
        _sent(batch, part, settings, sender, got)


def publish_step(spark: SparkSession, store: Outbox, settings: Settings, sender: Callable[[DataFrame, Settings], None] = send) -> dict[str, int]:
    """One round over the oldest pending entries, each that was tried with a result of its own.

    At least once: a crash between sending and noting sends the batch again, and so does a failure within it.
    """
    rows = next_batch(store.waiting(), settings.outbox_batch).collect()  # at most outbox_batch
    if not rows:
        return {"sent": 0, "failed": 0}
    batch = spark.createDataFrame(rows, store.waiting().schema)
    done: dict[str, str | None] = {}
    try:
        _sent(batch, [r["id"] for r in rows], settings, sender, done)
    except _Down:
        pass  # the others stay as they are
    epoch = {r["id"]: r["epoch"] for r in rows}
    results = spark.createDataFrame([(i, e, epoch[i]) for i, e in done.items()], "id string, error string, epoch int").withColumn("triedAt", F.current_timestamp())
    store.note(results.coalesce(1))
    if len(store.results.current().folders) > settings.outbox_settle:
        store.settle()
    failed = sum(e is not None for e in done.values())
    return {"sent": len(done) - failed, "failed": failed}


def publish(spark: SparkSession, store: Outbox, settings: Settings, stop: Callable[[], bool] = lambda: False, sender: Callable[[DataFrame, Settings], None] = send) -> int:
    """Steps until ``stop`` says so, with a pause after each; returns how many entries were sent."""
    sent = 0
    while not stop():
        sent += publish_step(spark, store, settings, sender)["sent"]
        time.sleep(settings.outbox_pause)
    return sent
