"""Stream-stream joins within an interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed(first: DataFrame, then: DataFrame, key: str, at: str, by: str, within: str, how: str = "left_outer", late: str = "10 minutes") -> DataFrame:
    """Each row of ``first`` with the rows of ``then`` that have its key and follow it ``within`` an interval, its ends included.

    On streams both sides carry a watermark, so state is dropped once nothing can match it any more, and an outer row comes once,
    when its interval has passed; on batches the same condition is an ordinary join. Rows of ``first`` without key or time can't be followed;
    the outer join keeps them on a batch, and on a stream those that have a time. ``then`` must not share names other than the key with ``first``.
    """
    if how not in ("inner", "left_outer"):
        raise ValueError(f"{how} isn't inner or left_outer")
    right = then.withColumnRenamed(key, "_key")
    if first.isStreaming:
        first, right = first.withWatermark(at, late), right.withWatermark(by, late)
    near = (F.col(key) == F.col("_key")) & (F.col(by) >= F.col(at)) & (F.col(by) <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return first.join(right, near, how).drop("_key")
