"""WARC archives: a deterministic sharded writer, and a reader that verifies what it reads.

Records are range-sorted by (page_id, payload digest, url): ranges of page_id and digest are cut where equal
shares of the payload bytes end, a shard and a task a range. Each shard is a chain of files that roll by
compressed size; each starts with a warcinfo record. A record is a gzip member of its own with regenerated
headers, so the bytes of all files depend on the records alone. Payloads that repeat are stored once
(response), by the largest page_id; the others are revisits that name its record, its URI and its page.

A task writes files under a temporary name of its own and returns their manifest rows. The manifest is
committed as a Parquet table by Spark, so only attempts that succeeded are in it; then each file of the
manifest gets its final name, which may be repeated at will. Readers take the names from the manifest:
a lost or repeated attempt leaves temporary files but never a record twice. Once all files have their names,
what is left of temporary ones is deleted.

Files are written through pyarrow's file systems (local, HDFS, S3, GCS), and read by Spark.

Defined results: a null payload is empty, and empty payloads equal each other; of rows with the same
page_id and payload one is the response (the first by url), the others revisit it; equal rows get record
ids of their own; a null page_id sorts first and is smaller
than all others; a null url is written as an empty target; an empty table gives an archive without
files; other columns are ignored. A page_id that isn't of an integer type is refused (TypeError).
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _ranges, _store

#: Compressed bytes after which a file rolls, and payload bytes of a shard (more beyond 65536 shards).
ROLL = 16 << 20
SHARD = 32 << 20
#: Payloads of at least so many bytes are stored once.
MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
NO_ID = -(2**63)
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "shard long, part int, name string, temp string, bytes long, records long, sha256 string"


def _file_system(path: str):
    """pyarrow's file system of a Hadoop path, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://"))


def record_id(page_id: int, url: str, digest: str, copy: int = 0) -> str:
    """A record's name; ``copy`` counts equal rows."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}|{url}|{digest}' + f'|{copy}' * bool(copy))}>"


def target(url: str) -> str:
    return quote(url, safe=";/?:@&=+$,#%!*()~[]'")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: tuple[int, str] | None, length: int, copy: int = 0, date: str = DATE) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` (page and url of the response) a revisit, which holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    shown = lambda x: "" if x == NO_ID else x
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        f"X-Page-ID: {shown(page_id)}",
    ]
    if refers_to is not None:
        top, where = refers_to
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(top, where, digest)}",
            f"WARC-Refers-To-Target-URI: {target(where)}",
            f"WARC-Refers-To-Date: {date}",
            f"X-Refers-To-Page-ID: {shown(top)}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    """The record that a file starts with."""
    block = b"software: orderloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMES, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}",
            f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Shard:
    """The files of one shard under temporary names."""

    def __init__(self, root: str, shard: int, roll: int):
        self.fs, self.path = _file_system(root)
        self.shard, self.roll, self.part, self.out, self.rows = shard, roll, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.temp = f"_temporary-{uuid.uuid4().hex}-{self.name}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.path}/{self.temp}", compression=None), 0, 0, hashlib.sha256()
            self._put(member(info(self.name)))
        self._put(data)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.part, self.name, self.temp, self.size, self.records, self.sha.hexdigest()))
            self.out, self.part = None, self.part + 1


def _write(batches, root: str, roll: int):
    """Rows sorted by (shard, _id, digest, kind, url): notes on a payload's copies (kind 0) before the records they are about."""
    now, note, first, last, copy = None, None, None, None, 0

    def ended():
        now.close()
        rows = list(zip(*now.rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "part", "name", "temp", "bytes", "records", "sha256"]
        )

    for batch in batches:
        for shard, i, url, digest, kind, payload, top in zip(*(batch.column(c).to_pylist() for c in range(7))):
            if now is None or now.shard != shard:
                if now is not None:
                    yield ended()
                now = _Shard(root, shard, roll)
            if kind == 0:
                note = (i, digest, top, url)
                continue
            payload = payload or b""
            refers = note[2:] if note and note[:2] == (i, digest) else None
            if refers and refers[0] == i:
                refers = refers if first == (i, digest) else None  # of the rows with the largest page_id, one is the response
                first = (i, digest)
            copy = copy + 1 if last == (i, url, digest) else 0
            last = (i, url, digest)
            now.add(member(record(i, url, payload, base32(bytes.fromhex(digest)), refers, len(payload), copy)))
    if now is not None:
        yield ended()


def _renamed(batches, root: str):
    """Gives each file of the manifest its final name; a name given before stays."""
    fs, path = _file_system(root)
    for batch in batches:
        for name, temp, size in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "temp", "bytes"))):
            final, source = fs.get_file_info([f"{path}/{name}", f"{path}/{temp}"])
            if source.type == pafs.FileType.File:
                fs.move(source.path, final.path)
            elif final.type != pafs.FileType.File or final.size != size:
                raise OSError(f"{temp} is missing")
        yield batch


def write_archive(pages: DataFrame, root: str, roll: int = ROLL, shard_bytes: int = SHARD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all rows of (page_id, url, html) below ``root`` and returns the committed manifest."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select(F.coalesce(_store.long_id(pages, "page_id"), F.lit(NO_ID)).alias("_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    fs, path = _file_system(root)
    fs.create_dir(path, recursive=True)
    light = _store.written(keyed.select("_id", "url", F.sha1("payload").alias("digest"), (F.octet_length("payload") + 512).cast("long").alias("_size")), "pages")
    order = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    cuts = _ranges.cuts(light.withColumn("_th", order), shard_bytes)
    shard = _ranges.number(cuts, "_id", order).cast("long").alias("shard")

    same = light.where(F.col("_size") >= min_bytes + 512).groupBy("digest", "_id").agg(F.min("url").alias("url"), F.count("*").alias("n"))
    copies = same.groupBy("digest").agg(F.max(F.struct("_id", "url")).alias("top"), F.sum("n").alias("n")).where("n > 1").select("digest", F.col("top._id").alias("top"), F.col("top.url").alias("top_url"))
    copies = _store.written(copies, "copies")
    notes = light.select("_id", "digest").join(copies, "digest").select(shard, "_id", F.col("top_url").alias("url"), "digest", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("payload"), "top").distinct()
    records = keyed.select("_id", "url", F.sha1("payload").alias("digest"), F.lit(1).alias("kind"), "payload", F.lit(None).cast("long").alias("top"))
    records = records.select(shard, "_id", "url", "digest", "kind", "payload", "top")
    rows = records.unionByName(notes).repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "_id", "digest", "kind", "url")
    written = rows.mapInArrow(lambda b: _write(b, root, roll), _MANIFEST)
    with _store.cleaned(spark):
        written.write.parquet(f"{root}/_manifest")
    _store.dropped(light, copies)
    manifest = spark.read.schema(written.schema).parquet(f"{root}/_manifest")
    manifest.mapInArrow(lambda b: _renamed(b, root), _MANIFEST).count()
    _swept(spark, root)
    return manifest


def _swept(spark, root: str) -> None:
    """Deletes the temporary files that failed or repeated attempts left."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_temporary-*")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for left in fs.globStatus(path) or ():
        fs.delete(left.getPath(), False)


def _records(batches):
    """(page_id, type, refers_to, url, digest, payload bytes, payload) of each record, its digests recomputed."""
    fields = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "record_type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload"]
    for batch in batches:
        for content in batch.column(0):
            data, rows = content.as_buffer(), []
            view, at, held = memoryview(data), 0, 0
            while at < len(view):
                z = zlib.decompressobj(31)
                raw, step = io.BytesIO(), at
                while not z.eof:
                    raw.write(z.decompress(view[step : step + (1 << 20)]))
                    step = min(len(view), step + (1 << 20))
                at = step - len(z.unused_data)
                if (one := _parsed(raw.getvalue())) is None:
                    continue
                rows.append(one)
                held += len(one[6] or b"")
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields)], names)


def _parsed(raw: bytes) -> tuple | None:
    """A page's record; None for a file's own record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or base32(hashlib.sha1(block).digest()) != h["WARC-Block-Digest"][5:]:
        raise ValueError("damaged record")
    if h["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = h["WARC-Payload-Digest"][5:], h["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError("damaged payload")
    number = lambda x: int(x) if x else None
    return number(h["X-Page-ID"]), kind, number(h.get("X-Refers-To-Page-ID", "")), h["WARC-Target-URI"], digest, length, payload if kind == "response" else None


def read_archive(spark, root: str) -> DataFrame:
    """The records of exactly the files that the manifest names; fails where one is missing or differs in size."""
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("target_uri", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])
    manifest = spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest").select("name", "bytes")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(root).withColumn("name", F.element_at(F.split("path", "/"), -1))
    bad = manifest.join(files.select("name", "length"), "name", "left").where("length is null or length <> bytes").first()
    if bad:
        raise OSError(f"{bad['name']} of the manifest " + ("is missing" if bad["length"] is None else f"has {bad['length']} instead of {bad['bytes']} bytes"))
    return files.join(F.broadcast(manifest.select("name")), "name", "left_semi").select("content").mapInArrow(_records, schema)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    root = _store.place(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_archive(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def local_files(root: str) -> dict[str, bytes]:
    """The archive's files, for tests."""
    path = _file_system(root)[1]
    return {x: open(f"{path}/{x}", "rb").read() for x in sorted(os.listdir(path)) if x.startswith("part-")}
