"""Digests, incremental sales, sessions, joins along time, sketches, the cube: edges that the queries don't show."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderloom.contracts import ContractError
from orderloom.operators import delivery, digests, metrics, sessions, sketches, temporal
from orderloom.plans import incremental

DAY = dt.date(2024, 1, 1)


def test_digests_tell_nulls_copies_and_keys(spark):
    kind = "id string, a int, b int"
    first = spark.createDataFrame([("k", 1, None), ("k", 1, None), ("m", None, 2), (None, 5, 5), ("same", 1, 1)], kind)
    second = spark.createDataFrame([("same", 1, 1), ("k", 1, None), ("m", 2, None), (None, 5, 6), ("new", 0, 0)], kind).select("b", "id", "a")
    got = {r.id: (r.kind, r.gone, r.come) for r in digests.differences(first, second, ["id"]).collect()}
    assert got == {"k": ("lost", 1, 0), "m": ("changed", 1, 1), None: ("changed", 1, 1), "new": ("extra", 0, 1)}
    assert digests.unequal_leaves(first, first.repartition(3), ["id"]) == [] and digests.differences(first, first, ["id"]).count() == 0
    assert digests.differences(first.limit(0), first.limit(0), ["id"]).count() == 0
    with pytest.raises(ContractError):
        digests.unequal_leaves(first, second.drop("b"), ["id"])


def test_digests_of_blocks_tell_nulls_and_copies(spark):
    first = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "a", None), (3, "a", "y"), (3, "a", "y"), (None, "n", "n"), (5, "a", "z")], "block int, id string, v string")
    second = spark.createDataFrame([(1, "b", "x"), (1, "a", None), (2, None, "a"), (3, "a", "y"), (None, "n", "m"), (6, "b", "z")], "block int, id string, v string").select("v", "block", "id")
    assert {r.block for r in digests.unequal_blocks(first, second, ["block"]).collect()} == {2, 3, None, 5, 6}
    assert digests.unequal_blocks(first, first.repartition(3), ["block"]).count() == 0
    with pytest.raises(ContractError):
        digests.unequal_blocks(first, second.drop("v"), ["block"])


def test_differences_scan_each_layer_once(spark, tmp_path):
    """Beside the scans for the digests: rows of the leaves that differ come from one scan and one shuffle of each layer."""
    for name, more in (("a", 0), ("b", 1)):
        spark.range(50).select(F.col("id").cast("string"), (F.col("id") % 7 + more).alias("x")).write.parquet(f"file://{tmp_path}/{name}")
    df = digests.differences(*(spark.read.parquet(f"file://{tmp_path}/{x}") for x in "ab"), ["id"])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert df.groupBy("kind").count().collect()[0].asDict() == {"kind": "changed", "count": 50}


def orders(spark, *rows):
    return spark.createDataFrame([(f"e{i}", DAY + dt.timedelta(d), "WEB", "SP", 1, r) for i, d, r in rows], "eventId string, eventDate date, channel string, location string, quantity int, revenue int").withColumn("revenue", F.col("revenue").cast("decimal(19,2)"))


def test_incremental_sales_leave_other_days_alone(spark, tmp_path):
    source, path = f"file://{tmp_path}/trusted", f"file://{tmp_path}/daily"
    put = lambda *rows: orders(spark, *rows).repartition(1).write.mode("append").partitionBy("eventDate").parquet(source)
    kept = lambda d: sorted((f.name, f.stat().st_mtime_ns) for f in (tmp_path / "daily" / "days" / f"eventDate={DAY + dt.timedelta(d)}").glob("*.parquet"))
    total = lambda: {(r.eventDate - DAY).days: (r.totalOrders, int(r.totalRevenue)) for r in incremental.daily_sales(spark, path).collect()}
    put((1, 0, 10), (2, 1, 20), (3, 2, 30))
    assert len(incremental.refresh_daily(spark, source, path).recomputed) == 3 and total() == {0: (1, 10), 1: (1, 20), 2: (1, 30)}
    before = kept(0)
    put((4, 1, 5), (5, 3, 1))
    assert [(d - DAY).days for d in incremental.refresh_daily(spark, source, path).recomputed] == [1, 3]
    assert total() == {0: (1, 10), 1: (2, 25), 2: (1, 30), 3: (1, 1)} and kept(0) == before
    for f in (tmp_path / "trusted" / f"eventDate={DAY + dt.timedelta(2)}").iterdir():
        f.unlink()
    done = incremental.refresh_daily(spark, source, path)
    assert (done.recomputed, done.removed) == ((), (DAY + dt.timedelta(2),)) and total() == {0: (1, 10), 1: (2, 25), 3: (1, 1)} and kept(0) == before
    assert incremental.refresh_daily(spark, source, path) == incremental.Refreshed((), ())
    # signatures that a crash didn't get to write: everything is done again, to the same result
    for f in (tmp_path / "daily" / "_days").rglob("_SUCCESS"):
        f.unlink()
    assert len(incremental.refresh_daily(spark, source, path).recomputed) == 3 and total() == {0: (1, 10), 1: (2, 25), 3: (1, 1)}


def at(seconds):
    return dt.datetime(2024, 1, 31, 23, 59, 0) + dt.timedelta(seconds=seconds)


def test_sessions_cross_buckets(spark):
    rows = spark.createDataFrame([(1, at(s)) for s in (0, 30, 61, 120, 300, 300)] + [(None, at(0)), (2, None)], "u long, t timestamp")
    got = sorted((r.u, r.events, (r.ended - r.started).seconds) for r in sessions.sessions(rows, "u", "t", 60, bucket=60).collect())
    assert got == [(1, 2, 0), (1, 4, 120)]
    assert sessions.sessions(rows.limit(0), "u", "t", 60).count() == 0


def test_as_of_carries_over_ranges(spark):
    events = spark.createDataFrame([("k", at(0), 1), ("k", at(59), 2), ("k", at(60), 3), ("k", at(90 * 86400), 4), ("x", at(0), 5), (None, at(0), 6), ("k", None, 7), ("k", at(60), 3)], "key string, t timestamp, _v int")
    prices = spark.createDataFrame([("k", at(30), 10), ("k", at(60), 20), ("k", at(60), 15), ("k", at(70), None), ("x", at(1), 9), (None, at(0), 1)], "key string, since timestamp, price int")
    got = sorted(((r._v, r.price) for r in temporal.as_of(events, prices, "key", "t", "since", ["price"]).collect()), key=str)
    assert got == [(1, None), (2, 10), (3, 20), (3, 20), (4, None), (5, None), (6, None), (7, None)]
    assert temporal.as_of(events.limit(0), prices, "key", "t", "since", ["price"]).count() == 0


def test_as_of_spreads_a_hot_key(spark):
    events = spark.range(2000).select(F.lit("k").alias("key"), (F.timestamp_seconds(F.col("id") * 86400)).alias("t"))
    prices = spark.range(0, 2000, 7).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 86400).alias("since"), F.col("id").alias("price"))
    out = temporal.as_of(events, prices, "key", "t", "since", ["price"])
    assert all(r.price == r.t.timestamp() // 86400 // 7 * 7 for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_k#" in plan and "_b#" in plan and "NestedLoop" not in plan


def test_range_join_is_exact_at_edges(spark):
    points = spark.createDataFrame([(1, p) for p in (-1, 0, 9, 10, 11, 19, 20, 1000, 2**40)] + [(1, None), (None, 10)], "k int, at long")
    held = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 20, "b"), (1, 0, 1001, "c"), (1, 5, 5, "none"), (1, -5, 2**41, "d"), (2, 0, 99, "e"), (None, 0, 99, "f"), (1, None, 9, "g")], "k int, start long, stop long, name string")
    met = temporal.range_join(points, held, ["k"], "at", "start", "stop", 10)
    want = sorted((p, n) for k, p in [(r.k, r.at) for r in points.collect()] for j, a, b, n in [tuple(r) for r in held.collect()] if k == j == 1 and p is not None and a is not None and a <= p < b)
    assert sorted((r.at, r.name) for r in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert temporal.range_join(points, held.limit(0), ["k"], "at", "start", "stop", 10).count() == 0


def test_sketches_merge_over_days(spark):
    rows = spark.range(20000).select((F.col("id") % 20).alias("day"), (F.col("id") % 5000).cast("string").alias("who"), F.when(F.col("id") % 100 != 0, F.col("id")).alias("v"))
    days = sketches.daily_sketches(rows, ["day"], {"who": "who"}, {"v": "v"})
    some = sketches.merged(days.where("day < 10"), [], ["who"], ["v"])
    r = sketches.estimates(some, [], ["who"], {"median": ("v", 0.5)}).first()
    assert r.rows == 10000 and abs(r.who - 2500) <= 0.05 * 2500 and abs(r.median - 10000) <= 0.05 * 20000


def test_cube_tells_subtotals_from_null_keys(spark):
    rows = spark.createDataFrame([("a", "WEB", 1, 10), ("b", None, 2, 30)], "eventId string, channel string, quantity int, revenue int").withColumn("revenue", F.col("revenue").cast("decimal(19,2)"))
    out = metrics.cube(rows, ("channel",))
    assert {(r.channel, r.level, r.totalOrders, int(r.totalRevenue), int(r.averageOrderValue)) for r in out.collect()} == {("WEB", 0, 1, 10, 10), (None, 0, 1, 30, 30), (None, 1, 2, 40, 20)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1


def test_requests_without_a_key_do_not_meet(spark):
    rows = spark.createDataFrame([(None, f"e{i}", at(0), 1) for i in range(50)] + [("k", "a", at(0), 1), ("k", "b", at(1), 2)], "idempotencyKey string, eventId string, createdAt timestamp, payloadHash long")
    out = delivery.accept(rows, rows.limit(0))
    assert {(r.eventId, r.answeredId, r.replayed, r.payloadConflict) for r in out.where("idempotencyKey is not null").collect()} == {("a", "a", False, False), ("b", "a", True, True)}
    assert out.where("idempotencyKey is null and not replayed and answeredId = eventId").count() == 50
    plain = delivery.accept(rows.where("idempotencyKey is null"), rows.limit(0)).where("idempotencyKey is null")
    assert plain.count() == 50


def test_as_of_shuffles_events_once(spark):
    """Four shuffles: what ranges hold, along keys, what is carried, and the rows; columns keep their places."""
    events = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", None)], "n int, key string, t int").select("n", "key", F.timestamp_seconds("t").alias("t"), "n")
    prices = spark.createDataFrame([("a", 1, 10)], "key string, since int, n int").withColumn("since", F.timestamp_seconds("since"))
    out = temporal.as_of(events.toDF("n", "key", "t", "m"), prices, "key", "t", "since", ["n"])
    assert out.columns == ["n", "key", "t", "m", "n"]
    assert sorted((r[0], r[1], r[3], r[4]) for r in out.collect()) == [(1, "a", 1, 10), (2, None, 2, None), (3, "a", 3, None)]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    assert temporal.as_of(events.toDF("n", "key", "t", "m"), prices, "key", "t", "since", ["n"])._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(_k") <= 4
