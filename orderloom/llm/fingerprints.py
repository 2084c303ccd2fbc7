"""Document fingerprints: a quartile bucket digest.

Byte triplets within windows of five bytes are hashed to buckets and counted over the whole text. A
bucket is encoded by the quartile of its count among all buckets of the text (2 bits), behind the
logarithm of the text's length. The difference of two digests adds up bucket distances, where opposite
quartiles weigh double, and the distance of the lengths; it is bounded, and likeness falls linearly
from 1 (no difference) to 0 (the bound).

The edited text needs the next document's beginning. Ranges of (doc_id, text hash) with about equal bytes
are sorted in tasks of their own; the first document of each range is also sent to the range before, so one
shuffle moves the texts once and no order of all documents is ever built in one task.

Defined results: a null text is empty and has the digest of no bytes; rows with the same doc_id follow
each other by the hash of their texts; a null doc_id is smaller than all others; a single document is its
own next; an empty table gives an empty result; other columns are ignored. A doc_id that isn't of an
integer type is refused (TypeError).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _ranges, _store, _text

BUCKETS = 512
#: Places of the triplets within a window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
#: Difference at and beyond which two texts are unlike.
BOUND = 0.9
#: Bytes of a range: at least, at most (more beyond 65536 ranges).
RANGE = (4 << 20, 32 << 20)
STEP = 1.1
NO_ID = -(2**63)
_K = np.random.default_rng(99).integers(1 << 20, 1 << 31, 16, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Distance of two quartiles.
_FAR = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int32)


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Quartile of each bucket (a row a text), and the length codes."""
    data, offs = _text.buffer(texts)
    n = len(offs) - 1
    counts = np.zeros((n, BUCKETS), np.int32)
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    at = 0
    while at < n:  # so many texts at a time that the temporary arrays stay small
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 20), "right")) - 1)
        part = data[offs[at] : offs[to]].astype(np.uint32) + np.uint32(1)
        row = np.repeat(np.arange(to - at, dtype=np.int64), np.diff(offs[at : to + 1])) * BUCKETS
        total = np.zeros((to - at) * BUCKETS, np.int64)
        for j, places in enumerate(TRIPLETS):
            m = len(part) - places[2]
            if m <= 0:
                continue
            h = part[places[0] : places[0] + m] * _K[0]
            h = (h ^ (h >> np.uint32(15))) + part[places[1] : places[1] + m] * _K[1]
            h = (h ^ (h >> np.uint32(13))) * _K[2] + part[places[2] : places[2] + m] * _K[3] + np.uint32(j) * _K[4]
            h = (h ^ (h >> np.uint32(16))) * _K[5]
            inside = row[:m] == row[places[2] : places[2] + m]
            total += np.bincount((row[:m] + (h >> shift))[inside], minlength=len(total))
        counts[at:to] = total.reshape(-1, BUCKETS)
        at = to
    order = np.sort(counts, axis=1)
    q = [order[:, BUCKETS * i // 4 - 1 : BUCKETS * i // 4] for i in (1, 2, 3)]
    code = sum((counts > x).astype(np.uint8) for x in q)
    size = np.round(np.log(np.maximum(np.diff(offs), 1)) / np.log(STEP)).astype(np.int64)
    return code, np.where(np.diff(offs) > 0, np.minimum(size + 1, 255), 0)


def encoded(code: np.ndarray, size: np.ndarray) -> list[str]:
    packed = code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6
    return [f"{int(s):02x}{row.tobytes().hex()}" for s, row in zip(size, np.ascontiguousarray(packed))]


def likeness(a: tuple, b: tuple) -> np.ndarray:
    """1 for equal digests, 0 at the bound."""
    body = _FAR[a[0], b[0]].sum(axis=1) / BUCKETS
    length = np.maximum(np.abs(a[1] - b[1]) - 1, 0) * 0.01
    return 1 - np.minimum((body + np.minimum(length, 0.3)) / BOUND, 1)


def edited_text(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def _emit(ids, texts, following):
    edit = [edited_text(t, f) for t, f in zip(texts, following)]
    one, two, three = (digests(pa.array(x, pa.large_string())) for x in (texts, edit, following))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if i == NO_ID else i for i in ids], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edit], pa.string()), pa.array(encoded(*one)), pa.array(encoded(*two)),
            pa.array(likeness(one, two), pa.float64()), pa.array(likeness(one, three), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _follow(batches):
    """Rows sorted by (range, guest, order): each own text with the next one; a range ends with a guest."""
    last, ids, texts, following, held = None, [], [], [], 0
    for batch in batches:
        for shard, guest, i, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if last is not None and last[0] == shard:
                ids.append(last[1])
                texts.append(last[2])
                following.append(text)
                held += len(last[2]) + len(text)
                if held > 2 << 20:
                    yield _emit(ids, texts, following)
                    ids, texts, following, held = [], [], [], 0
            last = None if guest else (shard, i, text)
    if ids:
        yield _emit(ids, texts, following)


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Digests of each text and of its edited text, with their likeness and that to the next document."""
    spark = docs.sparkSession
    n = _store.tasks(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(_store.long_id(docs, "doc_id"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text"))
    light = _store.written(rows.select("_id", "_th", (F.octet_length("text") + 100).cast("long").alias("_size")), "order")
    total = light.agg(F.sum("_size")).first()[0] or 0
    ends = _ranges.cuts(light, min(max(total // (2 * n), RANGE[0]), RANGE[1]))
    shard = _ranges.number(ends)
    tops = sorted(tuple(r) for r in light.groupBy(shard.alias("s")).agg(F.max(F.struct("_id", "_th")).alias("t")).select("s", "t._id", "t._th").collect())
    _store.dropped(light)
    if not tops:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # descending: what follows a range is the top of the one below, and the topmost after the lowest
    top_of = {s: (i, h) for s, i, h in tops}
    above = {s: tops[(k + 1) % len(tops)][0] for k, (s, _, _) in enumerate(tops)}
    size = len(ends) + 1
    array = _ranges.numbers
    at = F.col("shard") + 1
    own = [top_of.get(s, (0, 0)) for s in range(size)]
    is_top = (F.try_element_at(array(x[0] for x in own), at) == F.col("_id")) & (F.try_element_at(array(x[1] for x in own), at) == F.col("_th"))
    host = F.try_element_at(array(above.get(s, 0) for s in range(size)), at)
    here = F.struct(F.col("shard").alias("s"), F.lit(0).alias("guest"))
    rows = rows.withColumn("shard", shard).withColumn("place", F.explode(F.when(is_top, F.array(here, F.struct(host.alias("s"), F.lit(1).alias("guest")))).otherwise(F.array(here))))
    rows = rows.select(F.col("place.s").alias("shard"), F.col("place.guest").alias("guest"), "_id", "text", "_th")
    rows = rows.repartitionById(size, F.col("shard").cast("int")).sortWithinPartitions("shard", "guest", F.desc("_id"), F.desc("_th")).select("shard", "guest", "_id", "text")
    return rows.mapInArrow(_follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
