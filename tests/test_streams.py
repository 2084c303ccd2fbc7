"""Real streams: late data, dedup state, restart, update mode."""

from __future__ import annotations

import datetime as dt
import json
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from orderloom import contracts
from orderloom.settings import Settings
from orderloom.streaming import layers

BASE = 1790894400  # a whole minute


def feed(spark, settings, number, *events):
    """One file of messages."""
    rows = []
    for i, (event_id, second, more) in enumerate(events):
        e = {"eventId": event_id, "eventType": "ORDER_CREATED", "eventVersion": 1, "occurredAt": BASE + second, "producer": "p", "customerId": "c", "productId": "p", "quantity": 1, "unitPrice": 2.5, "channel": "WEB", "location": "SP"} | more
        rows.append((b"k", json.dumps(e).encode(), "t", 0, number * 100 + i, dt.datetime(2026, 1, 1)))
    spark.createDataFrame(rows, contracts.MESSAGE).coalesce(1).write.mode("append").parquet(settings.at("topic", settings.topic))


@pytest.fixture
def settings(tmp_path):
    return Settings(root=f"file://{tmp_path}", source_format="parquet", files_per_trigger=1, wait_seconds=2, poll_seconds=0.1)


def step(spark, settings):
    layers.raw_layer(spark, settings, available_now=True).awaitTermination()
    q = layers.trusted_layer(spark, settings, available_now=True)
    q.awaitTermination()
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for s in p["stateOperators"])


def trusted(spark, settings):
    return sorted(r.eventId for r in spark.read.parquet(settings.trusted).collect())


@pytest.mark.parametrize("bounded", [False, True])
def test_late_rows_and_copies(spark, settings, bounded):
    settings = settings.but(bounded_dedup=bounded)
    feed(spark, settings, 0, ("a", 0, {}), ("a", 0, {}), ("bad", 0, {"quantity": 0}))
    assert step(spark, settings) == 0 and trusted(spark, settings) == ["a"]
    feed(spark, settings, 1, ("b", 3600, {}))
    step(spark, settings)
    feed(spark, settings, 2, ("late", 60, {}), ("c", 3700, {}))
    assert step(spark, settings) >= 1
    assert trusted(spark, settings) == ["a", "b", "c"]
    # a restart from the checkpoint remembers, a new time for an old id tells the variants apart
    feed(spark, settings, 3, ("a", 3650, {}), ("c", 3700, {}))
    step(spark, settings)
    assert trusted(spark, settings) == (["a", "a", "b", "c"] if bounded else ["a", "b", "c"])


def test_live_totals_are_upserted(spark, settings, tmp_path):
    path = settings.at("live")
    for n, (second, want) in enumerate([(5, 1), (50, 2), (60, 2)]):
        feed(spark, settings, n, (f"e{n}", second, {}))
        layers.live_metrics(spark, settings, available_now=True).awaitTermination()
        rows = {r.window_start.timestamp() - BASE: r.orders for r in layers.live_totals(spark, path).collect()}
        assert rows[0] == want
    assert rows == {0: 2, 60: 1}
    # a repeated batch replaces itself
    again = spark.read.parquet(f"{path}/batch=000000000000")
    layers.upsert(spark.createDataFrame(again.collect(), again.schema), 0, path)
    before = sorted(map(tuple, layers.live_totals(spark, path).collect()))
    assert {r[3] for r in before} == {1, 2}
    folders = lambda: sorted(x.name for x in (tmp_path / "live").iterdir() if x.name.startswith("batch="))
    old = {x: shutil.copytree(tmp_path / "live" / x, tmp_path / x) for x in folders()}
    layers.compact_live(spark, path)
    assert sorted(map(tuple, layers.live_totals(spark, path).collect())) == before and len(folders()) == 1
    for x in old:  # as a crash before the deletions leaves it
        shutil.copytree(old[x], tmp_path / "live" / x)
    assert sorted(map(tuple, layers.live_totals(spark, path).collect())) == before
    layers.compact_live(spark, path)
    feed(spark, settings, 7, ("e7", 62, {}))
    layers.live_metrics(spark, settings, available_now=True).awaitTermination()
    assert {r.window_start.timestamp() - BASE: r.orders for r in layers.live_totals(spark, path).collect()} == {0: 2, 60: 2}
    layers.compact_live(spark, path)
    layers.compact_live(spark, path)
    assert len(folders()) == 1 and {r.orders for r in layers.live_totals(spark, path).collect()} == {2}


def test_consumer_takes_each_event_once(spark, settings):
    feed(spark, settings, 0, ("a", 0, {}), ("a", 1, {}), ("zero", 0, {"quantity": 0}))
    layers.consumer(spark, settings, available_now=True).awaitTermination()
    feed(spark, settings, 1, ("a", 2, {}), ("b", 0, {}))
    layers.consumer(spark, settings, available_now=True).awaitTermination()
    assert sorted(r.eventId for r in layers.projection(spark, settings).collect()) == ["a", "b"]
    assert sorted(map(tuple, layers.processed(spark, settings).select("eventId", "eventType").collect())) == [("a", "ORDER_CREATED"), ("b", "ORDER_CREATED")]
    layers.dead_letter_queue(spark, settings, available_now=True).awaitTermination()
    dead = spark.read.json(settings.at("topic", f"{settings.topic}.DLT")).collect()
    assert [(r.topic, r.reasons) for r in dead] == [(f"{settings.topic}.DLT", ["quantity_not_positive"])]


def test_trusted_layer_waits_for_raw(spark, settings):
    with pytest.raises(TimeoutError):
        layers.trusted_layer(spark, settings.but(wait_seconds=0.2))


def test_consumer_retries_then_dead_letters(spark, settings):
    feed(spark, settings, 0, ("a", 0, {}))
    calls = []

    def save(df, batch_id, settings):
        calls.append(batch_id)
        raise OSError("no store")

    settings = settings.but(consumer_pause=0.01)
    layers.consumer(spark, settings, available_now=True, save=save).awaitTermination()
    dead = spark.read.json(settings.at("dead", f"{settings.topic}.DLT")).collect()
    assert len(calls) == 3 and [(r.topic, r.reasons) for r in dead] == [(f"{settings.topic}.DLT", ["OSError: no store"])]
    feed(spark, settings, 1, ("b", 0, {}))

    def second(df, batch_id, settings):
        calls.append(batch_id)
        if len(calls) < 5:
            raise OSError("once")
        layers._consumed(df, batch_id, settings)

    layers.consumer(spark, settings, available_now=True, save=second).awaitTermination()
    assert [r.eventId for r in layers.projection(spark, settings).collect()] == ["b"]


def test_one_bad_record_is_dead_alone(spark, settings):
    assert layers.projection(spark, settings).collect() == [] and layers.processed(spark, settings).collect() == []
    feed(spark, settings, 0, ("a", 0, {}), ("b", 0, {}), ("bad", 0, {}), ("c", 0, {}))

    def save(df, name, settings):
        if not df.where("eventId = 'bad'").isEmpty():
            raise OSError("refused")
        layers._consumed(df, name, settings)

    settings = settings.but(consumer_pause=0.01)
    for _ in range(2):  # the second start finds nothing to do
        layers.consumer(spark, settings, available_now=True, save=save).awaitTermination()
        assert sorted(r.eventId for r in layers.projection(spark, settings).collect()) == ["a", "b", "c"]
        dead = spark.read.json(settings.at("dead", f"{settings.topic}.DLT")).collect()
        assert [(r.reasons, "bad" in r.value) for r in dead] == [(["OSError: refused"], True)]
    feed(spark, settings, 1, ("d", 0, {}), ("e", 0, {}))

    def down(df, name, settings):
        raise OSError("down")

    with pytest.raises(Exception, match="more than 1 records"):
        layers.consumer(spark, settings.but(consumer_dead=1), available_now=True, save=down).awaitTermination()
    layers.consumer(spark, settings, available_now=True).awaitTermination()
    assert sorted(r.eventId for r in layers.projection(spark, settings).collect()) == ["a", "b", "c", "d", "e"]


def _timed(spark, path, number, rows, kind):
    spark.createDataFrame([(k, dt.datetime.fromtimestamp(BASE + s, dt.UTC), *more) for k, s, *more in rows], kind).coalesce(1).write.mode("append").parquet(f"{path}/{number}")


def test_sessions_merge_on_a_stream(spark, tmp_path):
    from orderloom.operators.sessions import session_stream, sessions

    kind = "user long, at timestamp, v int"
    (tmp_path / "in").mkdir()
    stream = session_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in"), "user", "at", 60, "5 minutes", {"v": F.col("v")})
    batches = [[(1, 0, 1), (1, 100, 2), (2, 0, 1)], [(1, 60, 4), (1, 40, 8), (None, 1, 9)], [(1, 4000, 16), (2, 4000, 1)], [(1, 10, 99), (3, 9000, 1)]]
    for n, rows in enumerate(batches):
        _timed(spark, f"file://{tmp_path}/in", n, rows, kind)
        stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r.user, r.started.timestamp() - BASE, r.ended.timestamp() - BASE, r.events, r.v) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    # the late rows joined two sessions of user 1, at the gap's very end, too; the one behind the watermark is dropped
    assert got == {(1, 0, 100, 4, 15), (2, 0, 0, 1, 1), (1, 4000, 4000, 1, 16), (2, 4000, 4000, 1, 1)}
    same = spark.read.parquet(f"file://{tmp_path}/in/0", f"file://{tmp_path}/in/1", f"file://{tmp_path}/in/2")
    batch = sessions(same, "user", "at", 60, {"v": F.col("v")}, bucket=50)
    assert {(r.user, r.started.timestamp() - BASE, r.ended.timestamp() - BASE, r.events, r.v) for r in batch.collect()} == got


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_followed_on_a_stream_is_followed_on_a_batch(spark, tmp_path, how):
    from orderloom.streaming.joins import followed

    a, b = "id string, at timestamp", "id string, by timestamp, n int"
    first = [[("x", 0), ("y", 0), ("z", 10)], [("w", 1000)], [("end", 90_000)], []]
    then = [[("x", 30, 1), ("x", 60, 2)], [("y", 61, 3), ("w", 1000, 4)], [("end", 90_001, 5)], [("z", 20, 6)]]
    for name in "ab":
        (tmp_path / name).mkdir()
    side = lambda name, kind: spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/{name}")
    for n, (f, t) in enumerate(zip(first, then)):
        _timed(spark, f"file://{tmp_path}/a", n, f, a)
        _timed(spark, f"file://{tmp_path}/b", n, t, b)
        out = followed(side("a", a), side("b", b), "id", "at", "by", "1 minute", how)
        out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    read = lambda name: spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/{name}")
    got = sorted((r.id, r.n or 0) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    # z's follower came behind the watermark; what the stream still waits for isn't there
    want = followed(read("a"), read("b").where("n <> 6"), "id", "at", "by", "1 minute", how)
    assert got == sorted((r.id, r.n or 0) for r in want.collect())
    assert got == [("end", 5), ("w", 4), ("x", 1), ("x", 2), *([("y", 0), ("z", 0)] if how == "left_outer" else [])]


def test_overdue_entries_are_told_once_across_restarts(spark, tmp_path):
    from orderloom.streaming.overdue import overdue

    (tmp_path / "in").mkdir()
    kind = "id string, at timestamp, kind string"
    source = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    batches = [
        [("slow", 0, "created"), ("quick", 0, "created"), ("quick", 30, "settled"), ("early", 10, "settled"), (None, 0, "created")],
        [("early", 5, "created"), ("twice", 20, "created"), ("twice", 20, "created"), ("tardy", 20, "created"), ("tardy", 200, "settled")],
        [("clock", 2000, "settled")], [("slow", 1990, "settled"), ("clock", 2001, "settled")], [("clock", 90_000, "settled")], [],
    ]
    told = []
    for n, rows in enumerate(batches):
        _timed(spark, f"file://{tmp_path}/in", n, rows, kind)
        overdue(source, "1 minute", "1 hour", "1 minute").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        told.append(sorted((r.id, r.settledAt and r.settledAt.timestamp() - BASE, r.dueAt.timestamp() - BASE) for r in spark.read.schema("id string, createdAt timestamp, settledAt timestamp, dueAt timestamp").parquet(f"file://{tmp_path}/out").collect()))
    assert told[-1] == [("slow", None, 60), ("tardy", 200, 80), ("twice", None, 80)] and told[2] == told[-1]
    with pytest.raises(ValueError):
        overdue(source, "1 hour", "1 minute")


def test_both_queries_end_together(spark, settings):
    feed(spark, settings, 0, ("a", 0, {}))
    broken = settings.but(live_window="no window")
    with pytest.raises(Exception):  # noqa: B017
        layers.run_all(spark, broken, poll=0.1)
    for q in spark.streams.active:
        q.stop()
    timer = threading.Timer(6, lambda: next(q for q in spark.streams.active if q.name == "live_metrics").stop())
    timer.start()
    layers.run_all(spark, settings, poll=0.1)
    assert not spark.streams.active


def test_scratch_needs_a_shared_folder(monkeypatch):
    from unittest import mock

    from orderloom.sources import fixtures

    fake = mock.MagicMock()
    fake.conf.get.return_value = None
    fake.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        fixtures.scratch(fake, "x")
