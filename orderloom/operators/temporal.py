"""Joins along time: the last row as of an instant, and points in intervals. Both split a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def as_of(events: DataFrame, versions: DataFrame, key: str, at: str, since: str, values: list[str], bucket: Column | None = None) -> DataFrame:
    """Each event with ``values`` of its key's last version at or before ``at``; nulls where there is none.

    ``bucket`` maps an instant (column ``_t``) to a range of time, by default the month. Versions are carried from
    range to range by one row each, and within a range to its events, so a hot key's rows are spread over its ranges, and
    what is ordered along a whole key is a row a range. Of versions with one key and instant the largest values count.
    A null key or instant has no version.
    """
    bucket = F.date_trunc("month", "_t") if bucket is None else bucket
    v = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.struct(*values).alias("_v")).withColumn("_b", bucket)
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    # the key and the instant travel once
    rest = [c for c in events.columns if c not in (key, at)]
    e = events.where(known).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.struct(F.lit(True), *[F.col(f"`{c}`") for c in rest]).alias("_e")).withColumn("_b", bucket)
    none = F.lit(None).cast(v.schema["_v"].dataType)

    # what there is of each range, by one shuffle of at most a row a range and task
    last = F.struct("_t", "_v")
    both = v.select("_k", "_b", last.alias("_l")).unionByName(e.select("_k", "_b", F.lit(None).cast(v.select(last.alias("_l")).schema["_l"].dataType).alias("_l"))).groupBy("_k", "_b").agg(F.max("_l").alias("_last"))
    earlier = F.last("_last", ignorenulls=True).over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    carried = both.select("_k", "_b", earlier.getField("_v").alias("_carry")).where("_carry is not null")

    rows = e.withColumn("_v", none).unionByName(v.withColumn("_e", F.lit(None).cast(e.schema["_e"].dataType)))
    # the window's partitions are the join's, so its rows aren't shuffled again
    within = W.partitionBy("_k", "_b").orderBy("_t", F.col("_e").isNotNull(), "_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(within)).where("_e is not null")
    out = filled.join(carried, ["_k", "_b"], "left").withColumn("_v", F.coalesce("_v", "_carry"))
    shape = [(F.col("_k") if c == key else F.col("_t") if c == at else F.col(f"_e.`{c}`")).alias(c) for c in events.columns]
    answered = out.select(*shape, *[F.col(f"_v.{c}").alias(c) for c in values])
    return answered.union(events.where(~known).select("*", *[F.lit(None).cast(v.schema["_v"].dataType[c].dataType).alias(c) for c in values]))


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str, width: int) -> DataFrame:
    """Points with the intervals that hold them, start <= at < stop, of equal ``keys``; numbers such as microseconds.

    An interval belongs to the level whose bins, of ``width`` times a power of two, are as long as it is, so it lies in two
    bins at most; a point is looked for in its bin of each level that occurs (64 at most). So a pair meets once, an equi-join
    on (keys, level, bin) does the work, and a hot key is spread over its bins. Empty intervals and nulls hold nothing.
    """
    held = intervals.where(F.col(start) < F.col(stop)).withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2((F.col(stop) - F.col(start)) / width))).cast("int"))
    levels = [r[0] for r in held.select("_level").distinct().collect()]
    size = F.lit(width).cast("long") * F.pow(F.lit(2), F.col("_level")).cast("long")
    held = held.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(stop) - 1) / size))))
    spots = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", F.floor(F.col(at) / size))
    met = spots.join(held, [*keys, "_level", "_bin"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_level", "_bin")
