"""Mergeable sketches a day, from which any range of days gives distinct counts and percentiles without its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count (2 to this power; about 1.6 % standard error) and size of a quantile sketch (about 1.3 % of rank).
LG_K, KLL_K = 12, 200


def daily_sketches(rows: DataFrame, keys: Sequence[str], distinct: dict[str, str | Column], quantiles: dict[str, str | Column]) -> DataFrame:
    """One row for each combination of keys: its rows, a distinct-count sketch for each entry of ``distinct`` and a quantile sketch for each of
    ``quantiles``, named as given. Nulls are left out of them. Works on streams, with one of the keys a watermarked window."""
    hll = [F.hll_sketch_agg(c, F.lit(LG_K)).alias(n) for n, c in distinct.items()]
    kll = [F.kll_sketch_agg_double((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(KLL_K)).alias(n) for n, c in quantiles.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *hll, *kll)


def merged(sketches: DataFrame, keys: Sequence[str], distinct: Sequence[str], quantiles: Sequence[str]) -> DataFrame:
    """Sketches of coarser keys, or of everything without keys."""
    hll = [F.hll_union_agg(c).alias(c) for c in distinct]
    kll = [F.kll_merge_agg_double(c).alias(c) for c in quantiles]
    grouped = sketches.groupBy(*keys) if keys else sketches.groupBy()
    return grouped.agg(F.sum("rows").alias("rows"), *hll, *kll)


def estimates(sketches: DataFrame, keys: Sequence[str], distinct: Sequence[str], quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    """Distinct counts, and values at ranks: ``quantiles`` maps names to (sketch, rank)."""
    return sketches.select(*keys, "rows", *[F.hll_sketch_estimate(c).alias(c) for c in distinct], *[F.kll_sketch_get_quantile_double(c, F.lit(q)).alias(n) for n, (c, q) in quantiles.items()])
