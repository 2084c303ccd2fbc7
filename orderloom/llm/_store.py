"""Shared scratch tables, connected components and session helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType, StructField, StructType

_own: list[str] = []
#: Links that a task contracts at once, 16 bytes each.
CHUNK = 2_000_000
#: Shuffle files go at a query's end. Batches that Python gets hold so many bytes at most, whatever their rows hold: an executor has one in
#: its JVM, outside the heap, and one in Python for each task and each of its Python steps.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="orderloom-"))
        at = f"file://{_own[0]}"
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession):
    """Queries that are made and run within it remove their shuffle files at their end and pass Python small batches; the settings are put back."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = place(spark, name)
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written(), once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """Only the columns an operator works on, so that extra ones can't clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def long_id(df: DataFrame, name: str) -> Column:
    """The id as a long. Ids of other types than integers are refused at once, rather than when a task meets one."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{name} must be of an integer type, not {kind.simpleString()}; number the rows first")
    return F.col(name).cast("long")


class Kept:
    """Columns that pass by an operator, under names of its own on the way, so that any name may be given.

    One that is called like a column of the operator's result (``own``, in any case) gets as many underscores behind it as it takes.
    """

    def __init__(self, df: DataFrame, keep: list[str], own: list[str]):
        self._kept = [StructField(f"_keep{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
        self._given = [F.col("`" + c.replace("`", "``") + "`").alias(f.name) for c, f in zip(keep, self._kept)]
        taken = {c.lower() for c in (*keep, *own)}
        self.names = []
        for c in keep:
            if c.lower() in (x.lower() for x in own):
                while c.lower() in taken:
                    c += "_"
                taken.add(c.lower())
            self.names.append(c)

    def given(self, df: DataFrame, *more) -> DataFrame:
        return df.select(*self._given, *more)

    def shape(self, more: str) -> StructType:
        return StructType([*self._kept, *StructType.fromDDL(more)])

    def back(self, df: DataFrame, *more) -> DataFrame:
        return df.select(*[F.col(f.name).alias(c) for f, c in zip(self._kept, self.names)], *more)


def _lowest(rows: DataFrame) -> DataFrame:
    """(u, m, n): the smallest v of each u, and how many rows it has."""
    return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def met(rows: DataFrame, low: DataFrame, key: str, limit: int) -> DataFrame:
    """rows with the columns of ``low`` (a row a key, ``n`` the number of its rows). Keys of more than ``limit``
    rows, of which there can't be more than rows / limit, are broadcast, so that no task joins all rows of one."""
    more = [c for c in low.columns if c not in (key, "n")]
    hubs = F.broadcast(low.where(F.col("n") > limit).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_hub_{c}") for c in more]))
    marked = rows.join(hubs, F.col(key) == F.col("_k"), "left")
    hot = marked.where("_k is not null").select(*rows.columns, *[F.col(f"_hub_{c}").alias(c) for c in more])
    cold = marked.where("_k is null").select(*rows.columns).join(low.select(key, *more), key)
    return hot.union(cold.select(*rows.columns, *more))


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as a forest: each node and the smallest that these links reach, if that is another."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        live = x != y
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label = up
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _contract(batches, chunk: int):
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= chunk:
            held, n = [contracted(*(np.concatenate(c) for c in zip(*held)))], 0
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], ["u", "v"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in contracted(*(np.concatenate(c) for c in zip(*held)))], ["u", "v"])


def components(edges: DataFrame, limit: int = 60, chunk: int | None = None) -> DataFrame:
    """(u, v) undirected links of longs -> (node, component): the smallest node that links reach.

    Tasks contract ``chunk`` links at a time to forests. Where that leaves more than one chunk's forest,
    large-star and small-star steps join them, until a round changes nothing. Each step is a table in the
    shared folder. Nodes without links aren't returned; an empty input gives an empty result.
    """
    spark, chunk = edges.sparkSession, chunk or CHUNK
    shape = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    count = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    e = written(shape(edges.select("u", "v")), "edges")
    n = e.count()
    forest = written(e.coalesce(max(1, -(-n // chunk))).mapInArrow(lambda b: _contract(b, chunk), "u long, v long"), "edges")
    dropped(e)
    e = forest
    seen = count(e) if n > chunk else None
    for _ in range(limit if seen else 0):
        often = max(100, 2 * seen["n"] // tasks(spark))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).withColumn("m", F.least("u", "m"))
        large = met(both, low, "u", often).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _lowest(large)
        small = met(large, least, "u", often).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = written(shape(small), "edges")
        dropped(e)
        e, before, seen = new, seen, count(new)
        if seen == before:
            break
    else:
        if seen:
            raise RuntimeError("components didn't converge")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
    out._scratch = e._scratch
    return out
