"""Requests as a partitioned log with offsets, read by a Python data source: in batches or as a stream, and replayed from any offset.

The log is a folder of Parquet files named ``<partition>-<first offset>-<rows>.parquet``, as a gateway writes them; a file never changes.
``RequestLog`` lists the names to know where each partition ends, so planning opens no file. A start of a stream reads exactly the offsets
between the last start's end and its own; Spark keeps both in the checkpoint and asks for the same again after a crash (with the trigger
``availableNow``, that start ends with the repeated batch; the next one goes on). Each file's part of these is a task of its own, of at most ``rows`` offsets, and goes to Spark as Arrow batches.

Defined results: a missing or empty folder has no rows; a partition ends before the first gap in its offsets, so a file that appears late
is waited for, not passed over; other files in the folder are ignored; offsets before 0 and beyond the end are as far as there are rows.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "request_log"
SCHEMA = "partition int, offset long, idempotencyKey string, eventId string, createdAt timestamp, payloadHash long, payload string"
_ARROW = pa.schema([
    ("partition", pa.int32()), ("offset", pa.int64()), ("idempotencyKey", pa.string()), ("eventId", pa.string()),
    ("createdAt", pa.timestamp("us", "UTC")), ("payloadHash", pa.int64()), ("payload", pa.string()),
])
_NAME = re.compile(r"(\d+)-(\d+)-(\d+)\.parquet")
#: What a staged file holds, and what is told of each partition's rows in it.
_STAGED = pa.schema(list(_ARROW)[2:])
_PIECE = pa.schema([("range", pa.int32()), ("partition", pa.int32()), ("file", pa.string()), ("first", pa.int64()), ("rows", pa.int64())])
#: Rows of a file, and offsets of a task, at most.
FILE_ROWS = 20_000
COMPRESSION = "zstd"


def _listed(path: str) -> dict[int, list[tuple[int, int, str]]]:
    """(first offset, end, file) of each partition's files, up to the first gap."""
    at, folder = fs.FileSystem.from_uri(path)
    found: dict[int, list] = {}
    for info in at.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if m := _NAME.fullmatch(info.base_name):
            partition, first, rows = map(int, m.groups())
            found.setdefault(partition, []).append((first, first + rows, info.path))
    for partition, files in found.items():
        files.sort()
        end = 0
        for k, (first, to, _) in enumerate(files):
            if first != end:
                del files[k:]
                break
            end = to
    return {p: files for p, files in sorted(found.items()) if files}


def ends(path: str) -> dict[int, int]:
    """Where each partition ends: the offset that its next request gets."""
    return {p: files[-1][1] for p, files in _listed(path).items()}


@dataclass
class Stretch(InputPartition):
    """The offsets [start, end) of one partition, which lie in one file that begins at ``first``."""

    partition: int
    file: str
    first: int
    start: int
    end: int


def _stretches(path: str, start: dict[int, int], end: dict[int, int], rows: int) -> list[Stretch]:
    out = []
    for partition, files in _listed(path).items():
        low, high = start.get(partition, 0), end.get(partition, 0)
        for first, to, file in files:
            a, b = max(first, low), min(to, high)
            out += [Stretch(partition, file, first, x, min(x + rows, b)) for x in range(a, b, rows)]
    return out


def _batches(path: str, part: Stretch) -> Iterator[pa.RecordBatch]:
    at, _ = fs.FileSystem.from_uri(path)
    table = pq.read_table(part.file, filesystem=at, columns=_ARROW.names[2:]).slice(part.start - part.first, part.end - part.start)
    n = part.end - part.start
    if table.num_rows != n:
        raise ValueError(f"{part.file} doesn't hold the offsets {part.start} to {part.end}")
    table = table.add_column(0, "offset", pa.array(range(part.start, part.end), pa.int64())).add_column(0, "partition", pa.array([part.partition] * n, pa.int32()))
    yield from table.cast(_ARROW).combine_chunks().to_batches()


def _offsets(text: str | None) -> dict[int, int]:
    return {int(k): int(v) for k, v in json.loads(text or "{}").items()}


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", FILE_ROWS))
        self.start, self.end = _offsets(options.get("startingoffsets")), options.get("endingoffsets")

    def partitions(self) -> list[Stretch]:
        # a Python source needs a task, even to read nothing
        return _stretches(self.path, self.start, ends(self.path) if self.end is None else _offsets(self.end), self.rows) or [Stretch(0, "", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition) if partition.file else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.rows, self.first = options["path"], int(options.get("rows", FILE_ROWS)), _offsets(options.get("startingoffsets"))

    def initialOffset(self) -> dict:
        return {str(k): v for k, v in self.first.items()}

    def latestOffset(self) -> dict:
        return {str(p): end for p, end in ends(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return _stretches(self.path, *({int(k): v for k, v in x.items()} for x in (start, end)), self.rows) or [Stretch(0, "", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition) if partition.file else iter(())

    def commit(self, end: dict) -> None:
        """Nothing is let go: the log stays, so any offset can be replayed."""


class RequestLog(DataSource):
    """Options: the path, ``startingOffsets`` and (batch only) ``endingOffsets`` as JSON of partition to offset, and ``rows`` of a task."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def _json(offsets: dict[int, int]) -> str:
    return json.dumps({str(k): v for k, v in offsets.items()})


def replay(spark: SparkSession, path: str, start: dict[int, int] | None = None, end: dict[int, int] | None = None, rows: int = FILE_ROWS) -> DataFrame:
    """The requests from ``start`` on (0 where a partition isn't named) to ``end`` (all there are; with it, none of a partition that it doesn't name)."""
    spark.dataSource.register(RequestLog)
    reader = spark.read.format(FORMAT).option("rows", rows).option("startingOffsets", _json(start or {}))
    return (reader if end is None else reader.option("endingOffsets", _json(end))).load(path)


def stream(spark: SparkSession, path: str, start: dict[int, int] | None = None, rows: int = FILE_ROWS) -> DataFrame:
    """The requests as a stream; ``start`` counts at a query's first start only."""
    spark.dataSource.register(RequestLog)
    return spark.readStream.format(FORMAT).option("rows", rows).option("startingOffsets", _json(start or {})).load(path)


def _ranged(requests: DataFrame, partition: Column, order: tuple[str, ...], n: int) -> DataFrame:
    """The requests with their log partition along n ranges of (partition, order), a task each, sorted."""
    more = {c: f"_by_{c}" for c in order if c not in _ARROW.names[2:]}
    by = ["partition", *[more.get(c, c) for c in order]]
    rows = requests.select(partition.cast("int").alias("partition"), *_ARROW.names[2:], *[F.col(c).alias(name) for c, name in more.items()])
    return rows.repartitionByRange(n, *by).sortWithinPartitions(*by).drop(*more.values())


def _staged(batches: Iterator[pa.RecordBatch], path: str, inner: str) -> Iterator[pa.RecordBatch]:
    """Writes a range to one file of small row groups in a folder of the log, under a name of this try, and returns where the rows of each partition lie in it."""
    batch = next(batches, None)
    if batch is None:
        return
    at, folder = fs.FileSystem.from_uri(path)
    file, held, counts = f"{folder}/{inner}/{uuid.uuid4().hex}.parquet", [], {}
    with pq.ParquetWriter(file, _STAGED, filesystem=at, compression=COMPRESSION) as out:
        while batch is not None:
            for x in batch.column("partition").value_counts().to_pylist():  # in order, as the rows are sorted
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            held.append(batch)
            batch = next(batches, None)
            if batch is None or sum(b.num_rows for b in held) >= FILE_ROWS:
                out.write_table(pa.Table.from_batches(held).select(_STAGED.names).cast(_STAGED))
                held = []
    first = 0
    for partition, rows in counts.items():
        values = (TaskContext.get().partitionId(), partition, file, first, rows)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _PIECE.types)], _PIECE.names)
        first += rows


@dataclass
class Cut:
    """A run of a partition's rows that begins a file of the log, by the pieces of staged files that hold them: (file, first row, rows)."""

    partition: int
    offset: int
    pieces: list[tuple[str, int, int]]


def _cuts(pieces: list, held: dict[int, int], rows: int) -> list[Cut]:
    """For each piece the files that begin in it. Files are cut every ``rows`` requests of a partition, so the last one may go on into the pieces after it."""
    by: dict[int, list] = {}
    for r in sorted(pieces, key=lambda r: (r["partition"], r["range"])):
        before = by.setdefault(r["partition"], [])
        first = before[-1][1] if before else 0
        before.append((first, first + r["rows"], r["file"], r["first"]))
    out = []
    for partition, placed in by.items():
        for i, (first, end, _, _) in enumerate(placed):
            a, b = -(-first // rows) * rows, min(-(-end // rows) * rows, placed[-1][1])
            if a >= end:
                continue
            parts = []
            for lo, hi, file, row in itertools.takewhile(lambda x: x[0] < b, placed[i:]):
                x, y = max(lo, a), min(hi, b)
                parts.append((file, row + x - lo, y - x))
            out.append(Cut(partition, held.get(partition, 0) + a, parts))
    return out


def _read(at: fs.FileSystem, file: str, first: int, rows: int) -> Iterator[pa.Table]:
    """Rows of a staged file, by its row groups."""
    with pq.ParquetFile(file, filesystem=at) as source:
        begin = 0
        for k in range(source.num_row_groups):
            end = begin + source.metadata.row_group(k).num_rows
            a, b = max(first, begin), min(first + rows, end)
            if a < b:
                yield source.read_row_group(k).slice(a - begin, b - a)
            begin = end


def _written(cut: Cut, path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Writes the files of a cut, each by way of a hidden one, so a repeated task repeats its files."""
    at, folder = fs.FileSystem.from_uri(path)
    first, held, n = cut.offset, [], 0

    def put() -> pa.RecordBatch:
        name = f"{cut.partition}-{first}-{n}.parquet"
        hidden = f"{folder}/_{name}-{uuid.uuid4().hex}"
        pq.write_table(pa.concat_tables(held), hidden, filesystem=at, compression=COMPRESSION)
        if at.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
            at.move(hidden, f"{folder}/{name}")
        else:  # an earlier try of this task
            at.delete_file(hidden)
        return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    for piece in cut.pieces:
        for table in _read(at, *piece):
            while n + table.num_rows >= rows:
                k = rows - n
                held.append(table.slice(0, k))
                n, table = rows, table.slice(k)
                yield put()
                first, held, n = first + rows, [], 0
            if table.num_rows:
                held.append(table)
                n += table.num_rows
    if n:
        yield put()


@contextmanager
def _cleaned(spark: SparkSession):
    """Queries that are made and run within it remove their shuffle files at their end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def append(requests: DataFrame, path: str, partition: Column, *order: str, rows: int = FILE_ROWS) -> int:
    """Adds requests (idempotencyKey, eventId, createdAt, payloadHash, payload) behind what each partition holds, in ``order``; returns the number of files.
    ValueError for requests without a partition.

    Requests are shuffled once, to ranges of (partition, order), and each range goes to a staged file in a hidden folder of the log. Where a range's
    offsets begin follows from the others' counts; then the log's files are cut out of the staged ones, without a shuffle. On disk at once are the
    requests' shuffle and the staged files, and then these and the log's.

    One append at a time. One that is given up halfway leaves some of its requests (if its process dies, its staged files, too); appended again, they come twice, which intake answers by their keys.
    """
    spark = requests.sparkSession
    at, folder = fs.FileSystem.from_uri(path)
    at.create_dir(folder, recursive=True)
    staged = f"_staged-{uuid.uuid4().hex}"
    at.create_dir(f"{folder}/{staged}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        with _cleaned(spark):
            ranged = _ranged(requests, partition, order, n).mapInArrow(lambda b: _staged(b, path, staged), "range int, partition int, file string, first long, rows long")
            pieces = ranged.collect()  # n and one a partition at most
        if any(r["partition"] is None for r in pieces):
            raise ValueError("some requests have no partition")
        cuts = _cuts(pieces, ends(path), rows)
        write = lambda batches: (file for b in batches for i in b.column("id").to_pylist() for file in _written(cuts[i], path, rows))
        return spark.range(0, len(cuts), 1, max(1, len(cuts))).mapInArrow(write, "file string").count()
    finally:
        at.delete_dir(f"{folder}/{staged}")
