"""An index of ids that were dealt with: buckets by hash, each a folder, with Parquet's Bloom filters on the ids.

A look-up reads the buckets that its ids fall into, whatever came before. Up to ``LOOKUP`` ids are also pushed down one by one, so
that files whose Bloom filters (or ranges) hold none of them aren't decoded. A large batch that touches every bucket reads the index once.

Each batch of ids has a folder within the buckets, which a repeated batch of the same name replaces. ``fold`` makes one folder a bucket of
them; it is for one writer, between batches.

Defined results: a null id is never known and isn't kept; an id that is added twice is known once or more, which changes nothing; an
index without batches knows none; other columns stay as they are, whatever their names. The number of buckets is part of the
index: another one is refused (ValueError).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists, file_system

BUCKETS = 256
#: Ids that are pushed down one by one, at most.
LOOKUP = 100
_SCHEMA = "id string, batch string, bucket int"
_FOLDED = "folded"


class KnownIds:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = f"{root.rstrip('/')}/buckets-{buckets}"
        fs, at = file_system(spark, root)
        others = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        if any(x.startswith("buckets-") and x != f"buckets-{buckets}" for x in others):
            raise ValueError(f"{root} has {', '.join(sorted(others))}, not {buckets} buckets")

    def _placed(self, rows: DataFrame, column: str) -> DataFrame:
        given = rows.select(F.col("`" + column.replace("`", "``") + "`").cast("string").alias("id")).where("id is not null")
        return given.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        """(id, batch, bucket), replacing what these batches have in these buckets."""
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "batch", "id").select("id", "bucket", "batch")
        writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch")
        writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(self.path)

    def add(self, rows: DataFrame, column: str, batch: str) -> None:
        """Ids of a batch are known from now on."""
        if batch == _FOLDED:
            raise ValueError(f"a batch can't be called {_FOLDED}")
        self._write(self._placed(rows, column).distinct().withColumn("batch", F.lit(batch)))

    def all(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def touched(self, rows: DataFrame, column: str) -> DataFrame:
        """Known ids that may be among those of ``rows``, which are read for it: buckets (at most all), and ids if they are few."""
        asked = self._placed(rows, column)
        few = asked.distinct().limit(LOOKUP + 1).collect()
        if len(few) <= LOOKUP:
            hit = reduce(lambda a, b: a | b, [F.col("id") == r["id"] for r in few], F.lit(False))
            return self.all().where(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & hit).select("id")
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
        return self.all().where(F.col("bucket").isin(sorted(buckets))).select("id")

    def fresh(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows whose id isn't known."""
        known = self.touched(rows, column).select(F.struct("id").alias("_known"))
        return rows.join(known, rows["`" + column.replace("`", "``") + "`"].cast("string") == known["_known.id"], "left_anti")

    def fold(self) -> None:
        """One folder a bucket. The folded ids appear before the batches' folders go, so nothing is unknown in between."""
        rows = self.all()
        if rows.isEmpty():
            return
        batches = rows.where(F.col("batch") != _FOLDED).select("bucket", "batch").distinct()
        gone = [f"bucket={r['bucket']}/batch={r['batch']}" for r in batches.collect()]  # folders, which a fold bounds
        staged = f"{self.path}-fold"
        rows.groupBy("id", "bucket").agg(F.lit(_FOLDED).alias("batch")).write.mode("overwrite").parquet(staged)
        self._write(self.spark.read.schema("id string, bucket int, batch string").parquet(staged))
        fs, _ = file_system(self.spark, self.path)
        for x in (*(f"{self.path}/{g}" for g in gone), staged):
            fs.delete(file_system(self.spark, x)[1], True)
