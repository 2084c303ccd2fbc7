"""Ranges of a key of two integers with about equal weight; they follow from the rows, not from a sample."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store

#: Cells of the first histogram, and ranges at most; with more weight, each range is larger.
CELLS = 4096
MOST = 1 << 16
LOW, HIGH = -(2**63), 2**63 - 1


def numbers(values: Iterable[int], kind: str = "bigint") -> Column:
    """An array as one literal, however long."""
    text = ",".join(map(str, values))
    return F.split(F.lit(text), ",").cast(f"array<{kind}>") if text else F.array().cast(f"array<{kind}>")


def number(ends: list[tuple[int, int]], first: str | Column = "_id", second: str | Column = "_th") -> Column:
    """How many upper ends are below (first, second), by binary search: the number of a key's range."""
    if not ends:
        return F.lit(0)
    a, b = (F.col(c) if isinstance(c, str) else c for c in (first, second))
    x, y = numbers(e[0] for e in ends), numbers(e[1] for e in ends)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(ends).bit_length()))])

    def step(at: Column, width: Column) -> Column:
        e = F.try_element_at(x, at + width)
        return F.when((e < a) | ((e == a) & (F.try_element_at(y, at + width) < b)), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def cuts(keyed: DataFrame, target: int, first: str = "_id", second: str | None = "_th", weight: str = "_size") -> list[tuple[int, int]]:
    """Upper ends (first, second) of all ranges but the last.

    A histogram of equal cells; those that are too heavy are cut again, all of a level in one job, and
    cells of one ``first`` along ``second``. What the driver gets is bounded by MOST, not by the keys.
    """
    span = keyed.agg(F.min(first), F.max(first), F.sum(weight), F.count("*")).first()
    if not span[3]:
        return []
    target = max(target, (span[2] or 0) // MOST, 1)
    a, b, w = F.col(first), (F.col(second) if second else F.lit(0)).cast("long"), F.col(weight)
    lowest, highest = (LOW, HIGH) if second else (0, 0)
    leaves = []
    level = [((span[0], lowest), (span[1], highest), CELLS)]
    while level:
        level.sort()
        along = [0 if lo[0] < hi[0] else 1 for lo, hi, _ in level]
        base = [lo[k] for (lo, _, _), k in zip(level, along)]
        width = [(hi[k] - lo[k]) // m + 1 for (lo, hi, m), k in zip(level, along)]
        rows = keyed.select(a.alias("a"), b.alias("b"), w.alias("w"), number([hi for _, hi, _ in level], a, b).alias("i")).where(F.col("i") < len(level))
        at = lambda values, kind="bigint": F.try_element_at(numbers(values, kind), F.col("i") + 1)
        inside = (at(lo[0] for lo, _, _ in level) < F.col("a")) | ((at(lo[0] for lo, _, _ in level) == F.col("a")) & (at(lo[1] for lo, _, _ in level) <= F.col("b")))
        value = F.when(at(along) == 0, F.col("a")).otherwise(F.col("b")).cast("decimal(20,0)")
        cell = F.floor((value - at(base, "decimal(20,0)")) / at(width, "decimal(20,0)")).cast("long")
        with _store.cleaned(keyed.sparkSession):
            sizes = rows.where(inside).groupBy("i", cell.alias("c")).agg(F.sum("w").alias("w")).toPandas()
        heavy = []
        for i, c, size in zip(*(sizes[x].tolist() for x in ("i", "c", "w"))):
            (lo, hi, _), k = level[i], along[i]
            x, y = base[i] + c * width[i], min(hi[k], base[i] + (c + 1) * width[i] - 1)
            lo, hi = ((x, lowest), (y, highest)) if k == 0 else ((lo[0], x), (lo[0], y))
            if size > 2 * target and lo != hi:
                heavy.append((lo, hi, int(min(CELLS, max(2, 4 * size // target)))))
            else:
                leaves.append((lo, hi, size))
        level = heavy
    out, filled, last = [], 0, None
    for lo, hi, size in sorted(leaves):
        if filled and filled + size > 2 * target:
            out.append(last)
            filled = 0
        filled, last = filled + size, hi
        if filled >= target:
            out.append(hi)
            filled = 0
    return out if filled else out[:-1]
