"""Row-level reconciliation of two layers by a digest tree.

A row's hash goes into a leaf that its key chooses, and a leaf's digest is the count, the sum and the exclusive or of its hashes: a digest of a bag, whatever the
order of its rows. Leaves form branches. Layers are compared from the branches down; only rows of leaves that differ are
compared themselves. Equal layers therefore cost a scan each, and what is shuffled is a row a leaf and task, not the rows.

Nulls count as values, and null keys as one key. Repeated rows count as often as they come. Columns are matched by name; the two layers must have the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ContractError

BRANCHES, LEAVES = 256, 256
#: What became of a key's rows from the first layer to the second.
CHANGED, LOST, EXTRA = "changed", "lost", "extra"


def _leaf(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit("leaf"), *key, *[F.col(c).isNull() for c in key]), F.lit(BRANCHES * LEAVES)).cast("int")


def _value(df: DataFrame) -> Column:
    columns = sorted(df.columns)
    # nulls don't change xxhash64, so where they are is hashed, too
    return F.xxhash64(*columns, F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns]))


def leaf_digests(df: DataFrame, key: list[str]) -> DataFrame:
    """(branch, leaf, rows, total, parity): one row for each leaf that has rows; worth keeping beside a layer."""
    rows = df.select(_leaf(key).alias("leaf"), _value(df).alias("h"))
    return rows.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("parity")).withColumn("branch", F.expr(f"leaf div {LEAVES}").cast("int"))


def branch_digests(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("branch").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.bit_xor("parity").alias("parity"))


def _unequal(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    facts = ("rows", "total", "parity")
    both = a.select(on, *[F.col(c).alias(f"a_{c}") for c in facts]).join(b.select(on, *[F.col(c).alias(f"b_{c}") for c in facts]), on, "full")
    same = F.lit(True)
    for c in facts:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return both.where(~same).select(on)


def unequal_leaves(first: DataFrame, second: DataFrame, key: list[str]) -> list[int]:
    """Leaves whose rows differ; none if the layers are equal. The driver gets numbers of leaves, 65536 at most."""
    if sorted(first.columns) != sorted(second.columns):
        raise ContractError(f"columns differ: {sorted(set(first.columns) ^ set(second.columns))}")
    a, b = leaf_digests(first, key).persist(), leaf_digests(second, key).persist()
    try:
        branches = [r["branch"] for r in _unequal(branch_digests(a), branch_digests(b), "branch").collect()]
        if not branches:
            return []
        inside = F.col("branch").isin(branches)
        return sorted(r["leaf"] for r in _unequal(a.where(inside), b.where(inside), "leaf").collect())
    finally:
        a.unpersist()
        b.unpersist()


def differences(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """(key..., kind, gone, come) of each key whose rows differ: how many rows of it only one of the layers has.

    A key with rows on both sides that differ is ``changed``; one that the second layer lacks is ``lost``, one that the first
    lacks ``extra``; a key that only has more or fewer copies of the same row is extra or lost, too.
    """
    names = sorted(first.columns)
    leaves = unequal_leaves(first, second, key)
    spark = first.sparkSession
    few = F.broadcast(spark.createDataFrame([(x,) for x in leaves], "_leaf int"))  # at most 65536 numbers
    a, b = (df.select(*names).withColumn("_leaf", _leaf(key)).join(few, "_leaf", "left_semi").drop("_leaf") for df in (first, second))
    # copies of a row on either side, from one shuffle; F.count of a null counts nothing
    both = a.withColumns({"_a": F.lit(1), "_b": F.lit(None).cast("int")}).unionByName(b.withColumns({"_a": F.lit(None).cast("int"), "_b": F.lit(1)}))
    copies = both.groupBy(*names).agg((F.count("_a") - F.count("_b")).alias("_more")).where("_more <> 0")
    sides = copies.select(*key, F.greatest("_more", F.lit(0)).alias("g"), F.greatest(-F.col("_more"), F.lit(0)).alias("c"))
    each = sides.groupBy(*key).agg(F.sum("g").alias("gone"), F.sum("c").alias("come"))
    kind = F.when((F.col("gone") > 0) & (F.col("come") > 0), CHANGED).when(F.col("gone") > 0, LOST).otherwise(EXTRA)
    return each.select(*key, kind.alias("kind"), "gone", "come")


def unequal_blocks(first: DataFrame, second: DataFrame, block: list[str]) -> DataFrame:
    """The values of the columns ``block`` whose rows differ. For layers whose files hold most of a block together: a task adds up what it reads of
    one, so what is shuffled is a row a block and file."""
    if sorted(first.columns) != sorted(second.columns):
        raise ContractError(f"columns differ: {sorted(set(first.columns) ^ set(second.columns))}")
    a, b = (df.select(*block, _value(df).alias("h"), F.lit(side).alias("side")) for df, side in ((first, 1), (second, -1)))
    facts = (F.sum("side").alias("rows"), F.sum(F.col("side") * F.col("h").cast("decimal(20,0)")).alias("total"), F.bit_xor("h").alias("parity"))
    return a.union(b).groupBy(*block).agg(*facts).where("rows <> 0 OR total <> 0 OR parity <> 0").select(*block)
