"""Substring dedup: seed and extend.

Each text's words are hashed; of every window of ``length`` words the smallest gram of ``seed``
words is its winnowed anchor. Occurrences meet on equal anchors (the seeds), and are extended both
ways: within one anchor's occurrences, the whole windows around them are compared, and every window
whose words also start earlier is a repeat. Adjacent repeats join to maximal ones.

A chunk of texts first settles its own repeats and sends only the first occurrence of each window,
so a passage that a third of all documents hold reaches its reducer once a chunk. Windows are dealt by
their anchor, which keeps neighbours together. All anchors are counted before, in ``CELLS`` cells of
their hash: those of a cell with more than ``HEAVY`` times its share of all windows (a common phrase in
many contexts) are dealt by the whole window instead, which also puts equal windows together.
The number of parts follows from the number of windows, so a part's size doesn't grow with the input.

Defined results: a null or wordless text has no words and loses none; a text under ``length`` words
has no window; of equal windows the earliest (smallest doc_id, then smallest start) stays; rows that
repeat a doc_id and its text are judged as one document and get equal results; a null doc_id comes first.
An empty table gives an empty result. A doc_id that isn't of an integer type is refused (TypeError). Extra columns are passed through only by ``dedup_substrings``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text
from ._text import U

LENGTH = 20
SEED = 8
CELLS = 1 << 16
HEAVY = 4
#: Windows of a part, on average at most.
PART = 4_000_000
_MASK = U((1 << 48) - 1)
_BLOB = "part int, kind int, blob binary"
_HIT = "_id long, _th long, s long, e long"


def _sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive numbers."""
    width = 1
    while width * 2 <= n:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    rest = n - width
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def _pack(ids, ths, doc, start, anchor, win) -> bytes:
    """Windows in order of text: runs of neighbours that share an anchor, then the windows."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    held, local = np.unique(doc[first], return_inverse=True)
    head = np.array([len(held), len(first), len(doc)], "<i8").tobytes()
    return head + b"".join((
        _text.planes(ids[held].view(U), 8), _text.planes(ths[held].view(U), 8),
        _text.planes(local, 4), _text.planes(start[first], 4), _text.planes(count, 4), _text.planes(anchor[first], 8), _text.planes(win, 6),
    ))


def _unpack(blob: bytes):
    d, r, n = np.frombuffer(blob, "<i8", 3)
    at, out = 24, []
    for k, width in ((d, 8), (d, 8), (r, 4), (r, 4), (r, 4), (r, 8), (n, 6)):
        a, at = _text.unplanes(blob, int(k), width, at)
        out.append(a)
    return out


def _cell(anchor: np.ndarray) -> np.ndarray:
    return (_text.mix(anchor) >> U(48)).astype(np.int64) % CELLS


def _loads(batches, length: int, seed: int):
    """(cell, windows) of a task's texts."""
    total = np.zeros(CELLS, np.int64)
    for batch in _text.pieces(batches, "text"):
        data, offs = _text.buffer(batch.column(0))
        starts, ends, first = _text.spans(data, offs, _text.SPACE)
        h = _text.word_hashes(data, starts, ends, fold=False)
        m = len(h) - length + 1
        if m <= 0:
            continue
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        inside = doc[:m] == doc[length - 1 :]
        total += np.bincount(_cell(_sliding_min(_text.grams(h, seed), length - seed + 1)[inside]), minlength=CELLS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["cell", "n"])


def crowded(texts: DataFrame, length: int, seed: int) -> tuple[int, np.ndarray]:
    """How many windows all texts have, and the cells of anchors with more than their share (at most CELLS / HEAVY)."""
    cells = texts.select("text").mapInArrow(lambda b: _loads(b, length, seed), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    with _store.cleaned(texts.sparkSession):
        got = cells.toPandas()  # at most CELLS rows
    n = got["n"].to_numpy(np.int64)
    heavy = np.zeros(CELLS, bool)
    heavy[got["cell"].to_numpy(np.int64)[n > HEAVY * n.sum() / CELLS + HEAVY]] = True
    return int(n.sum()), heavy


def _dealt(anchor: np.ndarray, win: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    """The part of each window; equal windows have equal anchors and get the same part."""
    key = np.where(heavy[_cell(anchor)], win, anchor)
    return (_text.mix(key) % U(parts)).astype(np.int32)


def _seeds(batches, length: int, seed: int, parts: int, heavy):
    """Per chunk: repeats that it settles itself (kind 1), and first windows dealt to parts (kind 0)."""
    salt = TaskContext.get().partitionId()
    for batch in _text.pieces(batches):
        data, offs = _text.buffer(batch.column(2))
        ids, ths = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        starts, ends, first = _text.spans(data, offs, _text.SPACE)
        h = _text.word_hashes(data, starts, ends, fold=False)
        m = len(h) - length + 1
        if m <= 0:
            continue
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        inside = np.flatnonzero(doc[:m] == doc[length - 1 :])
        if not len(inside):
            continue
        win = _text.grams(h, length)[inside]
        anchor = _sliding_min(_text.grams(h, seed), length - seed + 1)[inside]
        doc = doc[inside]
        start = inside - first[doc]
        # the first of equal windows, by (doc_id, start)
        order = np.argsort(win)
        s = win[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        repeat = np.zeros(len(win), bool)
        if same.any():
            held = order[same[1:] | same[:-1]]
            held = held[np.lexsort((ths[doc[held]], start[held], ids[doc[held]], win[held]))]
            w, d, p = win[held], ids[doc[held]], start[held]
            new = np.ones(len(held), bool)
            new[1:] = w[1:] != w[:-1]
            lead = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(held))))
            earlier = (d[lead] < d) | ((d[lead] == d) & (p[lead] < p))
            repeat[held[earlier]] = True
            breaks = np.ones(len(win), bool)
            breaks[1:] = (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1] + 1)
            at, n = _text.runs(repeat, breaks)
            if len(at):
                blob = b"".join(np.ascontiguousarray(x.astype("<i8")).tobytes() for x in (ids[doc[at]], ths[doc[at]], start[at], start[at] + n + length - 1))
                yield pa.RecordBatch.from_arrays([pa.array([salt % parts], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], ["part", "kind", "blob"])
        keep = ~repeat
        # identical rows of one document would only meet themselves
        doc, start, anchor, win = doc[keep], start[keep], anchor[keep], win[keep]
        part = _dealt(anchor, win, heavy.value, parts)
        win = win & _MASK
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order], prepend=-1))
        out = ([], [])
        for a, b in zip(cut, np.append(cut[1:], len(order))):
            k = order[a:b]
            out[0].append(int(part[k[0]]))
            out[1].append(_pack(ids, ths, doc[k], start[k], anchor[k], win[k]))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([0] * len(out[0]), pa.int32()), pa.array(out[1], pa.binary())], ["part", "kind", "blob"])


def _settle(blobs: list[bytes], length: int):
    """Of one part: (ids, ths, starts, ends) of the stretches whose windows also start earlier."""
    got = [_unpack(b) for b in blobs]
    runs = np.cumsum([0] + [len(g[2]) for g in got])
    ids = np.concatenate([g[0][g[2].astype(np.int64)] for g in got]).view(np.int64)
    ths = np.concatenate([g[1][g[2].astype(np.int64)] for g in got]).view(np.int64)
    start, count, anchor = (np.concatenate([g[i] for g in got]) for i in (3, 4, 5))
    win = np.concatenate([g[6] for g in got])
    del got, runs
    start, count = start.astype(np.int64), count.astype(np.int64)
    base = np.cumsum(count) - count
    # seeds: anchors that occur more than once
    order = np.argsort(anchor)
    s = anchor[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    live = np.sort(order[same[1:] | same[:-1]])
    if not len(live):
        return None
    run = np.repeat(live, count[live])
    at = _text.ragged(base[live], count[live])
    pos = start[run] + at - base[run]
    key = _text.mix(anchor[run]) + win[at] * U(0x9E3779B97F4A7C15)
    # extension: equal whole windows
    order = np.argsort(key)
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    held = order[same[1:] | same[:-1]]
    if not len(held):
        return None
    held = held[np.lexsort((pos[held], ids[run[held]], key[held]))]
    w, d, p = key[held], ids[run[held]], pos[held]
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    lead = np.repeat(first, np.diff(np.append(first, len(held))))
    late = np.sort(held[(d[lead] < d) | ((d[lead] == d) & (p[lead] < p))])
    if not len(late):
        return None
    r, p = run[late], pos[late]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(late)))
    return ids[r[first]], ths[r[first]], p[first], p[first] + n + length - 1


def _repeats(batches, length: int):
    def out(cols):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], ["_id", "_th", "s", "e"])

    held: list[bytes] = []
    part = None
    for batch in batches:
        for p, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if kind == 1:
                yield out(np.frombuffer(blob, "<i8").reshape(4, -1))
                continue
            if p != part and held:
                if (hits := _settle(held, length)) is not None:
                    yield out(hits)
                held = []
            part = p
            held.append(blob)
    if held and (hits := _settle(held, length)) is not None:
        yield out(hits)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_id": F.coalesce(_store.long_id(docs, "doc_id"), F.lit(-(2**63))), "_th": F.xxhash64("text")})


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(_id, _th, hits): for each text with repeated windows, their stretches of words [s, e)."""
    spark = docs.sparkSession
    n = _store.tasks(spark)
    texts = _keyed(_store.plain(docs, "doc_id", "text")).select("_id", "_th", "text")
    windows, cells = crowded(texts, length, seed)
    parts = max(8 * n, -(-windows // PART))
    heavy = spark.sparkContext.broadcast(cells)
    seeds = texts.mapInArrow(lambda b: _seeds(b, length, seed, parts, heavy), _BLOB)
    hits = seeds.repartition(n, "part").sortWithinPartitions("part").mapInArrow(lambda b: _repeats(b, length), _HIT)
    return hits.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("hits"))


def _cut(batches, text: int, hits: int):
    for batch in batches:
        kept, total, removed = [], [], []
        for t, h in zip(batch.column(text).to_pylist(), batch.column(hits).to_pylist()):
            words = (t or "").encode().split()
            n = len(words)
            if h:
                to, out = 0, []
                for x in h:
                    if x["s"] > to:
                        out += words[to : x["s"]]
                    to = max(to, x["e"])
                words = out + words[to:]
            kept.append(b" ".join(words).decode())
            total.append(n)
            removed.append(n - len(words))
        yield pa.RecordBatch.from_arrays(
            [c for i, c in enumerate(batch.columns) if i not in (hits,)] + [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
            [x for i, x in enumerate(batch.schema.names) if i not in (hits,)] + ["_kept", "_words", "_removed"],
        )


def dedup_substrings(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, with ``_kept`` (the words left, joined by one space), ``_words`` and ``_removed``.

    Columns of ``docs`` that have the names used here (``_kept _words _removed _id _th hits``) are left out.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("_kept", "_words", "_removed", "_id", "_th", "hits")])
    found = repeats(docs, length, seed)
    keyed = _keyed(docs)
    joined = keyed.join(found.hint("shuffle_hash"), ["_id", "_th"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "hits")
    at, last = docs.columns.index("text"), len(docs.columns)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _kept string, _words long, _removed long"
    return joined.mapInArrow(lambda b: _cut(b, at, last), out)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2(F.encode("_kept", "UTF-8"), 256).alias("kept_sha256"))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(dedup_substrings(_store.plain(docs, "doc_id", "text")))


def brute(rows, length: int = LENGTH) -> dict:
    """The same by one dictionary, for tests: doc_id -> (n_words, n_removed, sha256)."""
    texts = [(d, (t or "").encode().split()) for d, t in sorted(rows)]
    seen: dict = {}
    for d, w in texts:
        for i in range(len(w) - length + 1):
            seen.setdefault(tuple(w[i : i + length]), (d, i))
    out = {}
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] < (d, i):
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
