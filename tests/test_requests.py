"""The log of requests: exact offsets across restarts and crashes, replay, gaps, edges."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from orderloom import queries
from orderloom.operators import delivery
from orderloom.sources import requests


def rows(spark, first, n):
    return spark.range(first, first + n).select(
        F.concat(F.lit("k"), F.col("id")).alias("idempotencyKey"), F.concat(F.lit("e"), F.col("id")).alias("eventId"), F.timestamp_seconds(F.col("id")).alias("createdAt"),
        F.col("id").alias("payloadHash"), F.lit("{}").alias("payload"), "id", F.lit("x").alias("offset_"),
    )


@pytest.fixture
def log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert requests.append(rows(spark, 0, 95), path, F.col("id") % 3, "id", rows=10) == 12  # 32, 32 and 31 rows in files of 10
    return path


def got(df):
    return sorted((r.partition, r.offset, r.eventId) for r in df.collect())


def want(lo, hi, parts=(0, 1, 2)):
    return sorted((p, k, f"e{3 * k + p}") for p in parts for k in range(lo, hi) if 3 * k + p < 95)


def test_replay(spark, log):
    assert requests.ends(log) == {0: 32, 1: 32, 2: 31}
    assert got(requests.replay(spark, log)) == want(0, 99)
    assert got(requests.replay(spark, log, {0: 7, 1: 7, 2: 7}, {0: 23, 1: 23, 2: 23}, rows=4)) == want(7, 23)
    assert got(requests.replay(spark, log, {0: 5}, {0: 8, 1: 0})) == want(5, 8, (0,))
    assert got(requests.replay(spark, log, {0: 99}, {0: 999, 9: 5})) == []
    assert requests.replay(spark, log, end={}).count() == 0
    row = requests.replay(spark, log, {1: 3}, {1: 4}).selectExpr("*", "unix_seconds(createdAt) AS s").first()
    assert (row.partition, row.offset, row.idempotencyKey, row.payloadHash, row.payload, row.s) == (1, 3, "k10", 10, "{}", 10)


def test_tasks_are_stretches_of_files(spark, log):
    assert requests.replay(spark, log, rows=4).rdd.getNumPartitions() == 30  # three files of 10 in threes and a last one, by partition
    # a few offsets read the files that hold them only
    parts = requests._stretches(log, {0: 9, 1: 32, 2: 31}, requests.ends(log), 100)
    assert [(p.partition, p.start, p.end) for p in parts] == [(0, 9, 10), (0, 10, 20), (0, 20, 30), (0, 30, 32)]


def test_a_missing_folder_is_empty(spark, tmp_path):
    assert requests.replay(spark, f"file://{tmp_path}/none").count() == 0 and requests.ends(f"file://{tmp_path}/none") == {}
    assert requests.append(rows(spark, 0, 0), f"file://{tmp_path}/new", F.lit(0), "id") == 0


def test_a_gap_is_waited_for(spark, log, tmp_path):
    os.rename(tmp_path / "log/1-10-10.parquet", tmp_path / "hidden")
    (tmp_path / "log/readme.txt").write_text("x")
    assert requests.ends(log) == {0: 32, 1: 10, 2: 31}
    seen = start(spark, log, tmp_path)
    assert got(seen()) == sorted(want(0, 99, (0, 2)) + want(0, 10, (1,)))
    os.rename(tmp_path / "hidden", tmp_path / "log/1-10-10.parquet")
    assert got(start(spark, log, tmp_path)()) == want(0, 99)


def start(spark, log, tmp_path, **more):
    writer = requests.stream(spark, log, **more).writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint")
    writer.trigger(availableNow=True).start(f"{tmp_path}/seen").awaitTermination()
    return lambda: spark.read.schema(requests.SCHEMA).parquet(f"{tmp_path}/seen")


def test_restarts_read_what_is_new(spark, log, tmp_path):
    assert got(start(spark, log, tmp_path, start={0: 30, 1: 30, 2: 30})()) == want(30, 99)
    start(spark, log, tmp_path)
    assert requests.append(rows(spark, 95, 4), log, F.lit(1), "id") == 1
    out = got(start(spark, log, tmp_path)())
    assert out == sorted(want(30, 99) + [(1, 32 + k, f"e{95 + k}") for k in range(4)])


def test_a_crash_reads_the_same_offsets_again(spark, log, tmp_path):
    tries = []

    def take(batch, k):
        tries.append((k, got(batch)))
        if len(tries) == 1:
            raise OSError("crash")

    def run():
        requests.stream(spark, log).writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/other").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="crash"):
        run()
    # what comes between the crash and the restart isn't mixed in
    requests.append(rows(spark, 95, 2), log, F.lit(0), "id")
    run()  # repeats the lost batch, and nothing else
    assert len(tries) == 2
    run()
    assert tries[0] == tries[1] == (0, want(0, 99)) and [k for k, _ in tries] == [0, 0, 1]
    assert tries[2][1] == [(0, 32, "e95"), (0, 33, "e96")]


def test_a_given_up_append_is_answered_once(spark, log):
    requests.append(rows(spark, 90, 8), log, F.col("id") % 3, "id")  # 90 to 94 come again
    read = requests.replay(spark, log)
    known = spark.createDataFrame([], "idempotencyKey string, eventId string, createdAt timestamp, payloadHash long")
    answers = delivery.accept(read, known, "partition", "offset")
    assert read.count() == 103 and sorted(r.eventId for r in delivery.accepted(answers).collect()) == sorted(f"e{i}" for i in range(98))
    assert answers.where("payloadConflict").count() == 0


def test_one_partition_is_numbered_along_ranges(spark, tmp_path):
    """One log partition for all requests: no task sorts more than its share, and offsets run through the ranges."""
    path, df = f"file://{tmp_path}/one", rows(spark, 0, 4000).repartition(3)
    most = requests._ranged(df, F.lit(0), ("id",), 8).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 1500
    assert requests.append(df.where("id < 1500"), path, F.lit(0), "id", rows=1000) == 2 and requests.append(df.where("id >= 1500"), path, F.lit(0), "id", rows=1000) == 3
    assert got(requests.replay(spark, path)) == [(0, k, f"e{k}") for k in range(4000)]


def test_requests_without_a_partition_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="requests have no partition"):
        requests.append(rows(spark, 0, 4), f"file://{tmp_path}/none", F.when(F.col("id") > 1, 0), "id")


def shuffled(spark, run):
    """How many records the stages of a run write to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    seen = stages()
    last = max((seen.apply(i).stageId() for i in range(seen.size())), default=-1)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    after = stages()
    return sum(x.shuffleWriteRecords() for x in map(after.apply, range(after.size())) if x.stageId() > last)


def test_an_append_shuffles_requests_once(spark, tmp_path):
    """Nothing else is kept of them than the log, even if they are refused."""
    path, df = f"file://{tmp_path}/log", rows(spark, 0, 4000).repartition(3).localCheckpoint()
    assert 4000 <= shuffled(spark, lambda: requests.append(df, path, F.col("id") % 3, "id", rows=100)) < 4400
    assert len(os.listdir(tmp_path / "log")) == 42 and not [x for x in os.listdir(tmp_path / "log") if not requests._NAME.fullmatch(x)]
    assert got(requests.replay(spark, path)) == sorted((p, k, f"e{3 * k + p}") for p in range(3) for k in range(1334) if 3 * k + p < 4000)
    with pytest.raises(ValueError, match="no partition"):
        requests.append(df, f"file://{tmp_path}/none", F.when(F.col("id") < 3000, 0), "id")
    assert os.listdir(tmp_path / "none") == []


def test_files_are_cut_across_ranges():
    piece = lambda partition, k, first, n: {"partition": partition, "range": k, "file": f"f{k}", "first": first, "rows": n}
    pieces = [piece(1, 2, 4, 3), piece(0, 0, 0, 25), piece(0, 1, 0, 2), piece(0, 2, 0, 4), piece(1, 3, 0, 10)]
    cuts = [(c.partition, c.offset, c.pieces) for c in requests._cuts(pieces, {1: 40}, 10)]
    assert cuts == [
        (0, 0, [("f0", 0, 25), ("f1", 0, 2), ("f2", 0, 3)]),  # the third file goes on over two more ranges
        (0, 30, [("f2", 3, 1)]),
        (1, 40, [("f2", 4, 3), ("f3", 0, 7)]),
        (1, 50, [("f3", 7, 3)]),
    ]


def test_what_was_streamed_meets_its_replay_by_blocks(spark, sf_dir, tmp_path):
    replayed = spark.range(5000).select((F.col("id") % 2).cast("int").alias("partition"), F.expr("id div 2").alias("offset"), F.col("id").cast("string").alias("idempotencyKey"), F.concat(F.lit("e"), "id").alias("eventId"), F.expr("int(1 + id div 3000)").alias("start"))
    key = replayed.drop("start").columns
    streamed = replayed.select(*key)
    odd = streamed.where("partition <> 1 OR offset <> 7").union(streamed.where("partition = 0 AND offset = 2001"))  # one lost, one twice
    odd = odd.withColumn("eventId", F.when(F.expr("partition = 1 AND offset = 1500"), F.lit("other")).otherwise(F.col("eventId")))
    for i, (other, want) in enumerate(((streamed, {}), (odd, {(1, 7, "e15", 1): None, (0, 2001, "e4002", 2): 2, (1, 1500, "e3001", 2): None, (1, 1500, "other", None): 1}))):
        rows = queries._met(replayed, other, f"file://{tmp_path}/{i}").collect()
        assert len(rows) == 5000 + (i > 0) and {(r.partition, r.offset, r.eventId, r.start): r.streamed for r in rows if r.streamed != 1 or r.start is None} == want
    # rows that are alike aren't shuffled for that
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert shuffled(spark, lambda: queries.requests_replayed(spark, sf_dir).collect()) < 1.2 * lines
