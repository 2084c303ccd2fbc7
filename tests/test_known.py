"""The index of known ids: which rows are fresh, what a look-up reads, replaced batches, folds, edges."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from orderloom.sources import known as module
from orderloom.sources.known import KnownIds


def ids(spark, first, n):
    return spark.range(first, first + n).select(F.concat(F.lit("e"), F.col("id")).alias("eventId"), F.col("id").alias("bucket"), F.lit("x").alias("batch"))


def fresh(index, rows):
    return sorted(r.bucket for r in index.fresh(rows, "eventId").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fresh_rows_of_batches(spark, tmp_path):
    index = KnownIds(spark, f"file://{tmp_path}/known", 8)
    assert fresh(index, ids(spark, 0, 3)) == [0, 1, 2]
    index.add(ids(spark, 0, 500), "eventId", "0")
    index.add(ids(spark, 400, 500), "eventId", "1")
    assert fresh(index, ids(spark, 890, 20)) == list(range(900, 910))
    assert fresh(index, ids(spark, 300, 1000)) == list(range(900, 1300))  # more than are pushed down one by one
    twice = ids(spark, 899, 2).union(ids(spark, 899, 2))
    assert fresh(index, twice) == [900, 900]
    assert index.fresh(twice, "eventId").columns == ["eventId", "bucket", "batch"]


def test_what_a_look_up_reads(spark, tmp_path, monkeypatch):
    index = KnownIds(spark, f"file://{tmp_path}/known", 16)
    index.add(ids(spark, 0, 4000), "eventId", "0")
    few = index.touched(ids(spark, 7, 2), "eventId")
    assert len(few.inputFiles()) == 16  # all that there are, before pruning
    assert "PartitionFilters: [" in plan(few) and "EqualTo(id,e7)" in plan(few) and "EqualTo(id,e8)" in plan(few)
    metrics = few._jdf.queryExecution().executedPlan()
    assert few.count() == 2 and "bucket" in metrics.toString()
    monkeypatch.setattr(module, "LOOKUP", 0)
    some = index.touched(ids(spark, 7, 2), "eventId")
    assert "EqualTo(id" not in plan(some) and 2 <= some.count() < 4000 / 4
    import pyarrow.parquet as pq

    name = next(os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet"))
    assert pq.ParquetFile(name).metadata.num_columns == 1 and os.path.getsize(name) > 0


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    index = KnownIds(spark, f"file://{tmp_path}/known", 4)
    for _ in range(2):
        index.add(ids(spark, 0, 50), "eventId", "a")
    assert index.all().count() == 50
    index.add(ids(spark, 20, 50), "eventId", "b")
    before = sorted(r.id for r in index.all().select("id").distinct().collect())
    index.fold()
    assert sorted(r.id for r in index.all().collect()) == before and {r.batch for r in index.all().collect()} == {"folded"}
    index.add(ids(spark, 100, 5), "eventId", "c")
    index.fold()
    assert index.all().count() == 75 and fresh(index, ids(spark, 68, 4)) == [70, 71]


def test_edges(spark, tmp_path):
    root = f"file://{tmp_path}/known"
    index = KnownIds(spark, root, 4)
    none = spark.createDataFrame([], "eventId string, bucket long, batch string")
    index.fold()
    index.add(none, "eventId", "0")
    assert index.all().count() == 0 and fresh(index, none) == []
    nulls = spark.createDataFrame([(None, 1, None), ("", 2, ""), (None, 3, "x")], "eventId string, bucket long, batch string")
    index.add(nulls, "eventId", "1")
    assert fresh(index, nulls) == [1, 3]
    odd = spark.createDataFrame([(1, 5), (2, 6)], "`a.b``c` long, id long")
    index.add(odd.limit(1), "a.b`c", "2")
    assert [r.id for r in index.fresh(odd, "a.b`c").collect()] in ([5], [6])
    with pytest.raises(ValueError):
        KnownIds(spark, root, 8)
    with pytest.raises(ValueError):
        index.add(odd, "id", "folded")
