"""Daily sales that only recompute days whose files changed.

What is kept beside the sales is a signature a day: its files in the trusted layer with their sizes and times, taken from Spark's
file metadata without reading a column. A refresh compares signatures, recomputes the days that differ from pruned partitions, and
replaces these partitions alone; days that are gone are removed. The signatures are written last and as a new folder, so a refresh that
crashed is repeated by the next one, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.files import exists, file_system

_SIGNATURE = "eventDate date, files long, mark decimal(38,0)"


@dataclass(frozen=True)
class Refreshed:
    recomputed: tuple
    removed: tuple


def signatures(trusted: DataFrame) -> DataFrame:
    """(eventDate, files, mark) of each day of a layer that is partitioned by eventDate."""
    files = trusted.select("eventDate", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    return files.groupBy("eventDate").agg(F.count("*").alias("files"), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")).alias("mark"))


def _kept(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The latest signatures, and their number."""
    fs, root = file_system(spark, f"{path}/_days")
    found = [int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(root)] if fs.exists(root) else []
    whole = [n for n in found if exists(spark, f"{path}/_days/run={n}/_SUCCESS")]
    if not whole:
        return spark.createDataFrame([], _SIGNATURE), max(found, default=-1)
    return spark.read.schema(_SIGNATURE).parquet(f"{path}/_days/run={max(whole)}"), max(found)


def refresh_daily(spark: SparkSession, source: str, path: str, keep: int = 2) -> Refreshed:
    """Brings the daily sales at ``path`` up to date with the trusted layer at ``source``.

    The driver sees changed days, one row each. A day that is in the layer but has no rows is removed.
    """
    trusted = spark.read.parquet(source)
    now = signatures(trusted).persist()
    try:
        old, run = _kept(spark, path)
        both = now.alias("n").join(old.alias("o"), "eventDate", "full").select("eventDate", F.col("n.mark").alias("new"), F.col("o.mark").alias("old"), F.col("n.files").alias("nf"), F.col("o.files").alias("of"))
        unequal = both.where(~(F.col("new").eqNullSafe(F.col("old")) & F.col("nf").eqNullSafe(F.col("of")))).select("eventDate", F.col("new").isNotNull().alias("there")).collect()
        changed = sorted(r["eventDate"] for r in unequal if r["there"])
        gone = {r["eventDate"] for r in unequal if not r["there"]}
        if changed:
            days = metrics.daily(trusted.where(F.col("eventDate").isin(changed)))
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            days.repartition(tasks, "eventDate").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("eventDate").parquet(f"{path}/days")
        fs, _ = file_system(spark, path)
        for day in gone:
            fs.delete(file_system(spark, f"{path}/days/eventDate={day}")[1], True)
        if unequal or run < 0:
            now.write.mode("overwrite").parquet(f"{path}/_days/run={run + 1}")
            for n in range(max(0, run + 2 - 2 * keep), run + 2 - keep):
                fs.delete(file_system(spark, f"{path}/_days/run={n}")[1], True)
        return Refreshed(tuple(changed), tuple(sorted(gone)))
    finally:
        now.unpersist()


def daily_sales(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/days")
