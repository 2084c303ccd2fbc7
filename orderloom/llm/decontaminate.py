"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``span`` consecutive words of an item (a shorter item is one window); its set are its
shingles of ``width`` words. To hold a window a text must hold all of its shingles, so one is a
necessary prefix: the rarest, by the number of documents that hold it, counted over all of them.
Texts join windows on that token only; its place must leave room for the window on both sides within
the text (positional and length bound), and then the whole window's words are compared.

The windows of up to ``BLOCK_WORDS`` item words are broadcast. More are joined by a shuffle: documents are
read three times, whatever the size of the benchmark. Bitmaps of the windows' tokens and then of the prefix
tokens (at most ``BITS`` bits) leave few places of the documents; each goes with the hashes of the words around it
to the windows of its token, where the whole window is compared. Windows of tokens that very many documents
hold are broadcast, so that no task gets all places of one token.

Defined results: null texts have no words; an item without words has no window; repeated item_ids
count once, a null item_id is named by the empty string; rows that repeat a doc_id and its text are
judged alike; an empty benchmark contaminates nothing; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text
from ._text import U

SPAN = 13
WIDTH = 5
#: Bits of a bitmap at most, and for each token.
BITS = 1 << 31
BITS_EACH = 32
#: Words of a bitmap's cell, which one task fills.
CELL = 1 << 14
#: Item words whose windows may be broadcast at once: about 13 * 8 bytes each.
BLOCK_WORDS = 400_000
_HITS = "_words long, _hits array<struct<s:long,e:long>>, _items array<string>"
#: Names of columns of mark() and contamination().
OWN = ["_words", "_hits", "_items", "n_words", "n_hit", "items", "contaminated"]


def _windows(batches, span: int, width: int):
    """(item, size, hash, tokens) of each window of the items."""
    for batch in _text.pieces(batches):
        data, offs = _text.buffer(batch.column(1))
        starts, ends, first = _text.spans(data, offs, _text.SYMBOL)
        h = _text.word_hashes(data, starts, ends, fold=True)
        names = batch.column(0).to_pylist()
        out: tuple = ([], [], [], [])
        for i in range(batch.num_rows):
            w = h[first[i] : first[i + 1]]
            if not len(w):
                continue
            size = min(span, len(w))
            k = min(width, size)
            whole, token = _text.grams(w, size), _text.grams(w, k)
            for s in range(len(whole)):
                out[0].append(names[i])
                out[1].append(size)
                out[2].append(int(whole[s : s + 1].view(np.int64)[0]))
                out[3].append(token[s : s + size - k + 1].view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))], ["item", "size", "hash", "tokens"])


class _Table:
    """Sorted 64-bit keys with a bitmap before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.may = np.zeros(1 << 22, bool)
        self.may[(keys & U((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x that hold a key, and the key's index."""
        hit = np.flatnonzero(self.may[(x & U((1 << 22) - 1)).astype(np.int64)])
        if not len(hit):
            return hit, hit
        at = np.minimum(np.searchsorted(self.keys, x[hit]), len(self.keys) - 1)
        same = self.keys[at] == x[hit]
        return hit[same], at[same]


def _words(batch, text: int):
    data, offs = _text.buffer(batch.column(text))
    starts, ends, first = _text.spans(data, offs, _text.SYMBOL)
    h = _text.word_hashes(data, starts, ends, fold=True)
    return h, first, np.repeat(np.arange(batch.num_rows), np.diff(first))


def _frequencies(batches, shared, widths: list[int]):
    """(token, documents) of the windows' tokens, once a task."""
    table = _Table(shared.value)
    total = np.zeros(len(table.keys), np.int64)
    for batch in _text.pieces(batches):
        h, _, doc = _words(batch, 0)
        for k in widths:
            if len(h) < k:
                continue
            at, key = table.find(_text.grams(h, k))
            inside = doc[at] == doc[at + k - 1]
            pair = np.unique(np.stack([key[inside], doc[at[inside]]]), axis=1)
            total += np.bincount(pair[0], minlength=len(total))
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(table.keys[held].view(np.int64)), pa.array(total[held])], ["token", "n"])


def _match(batches, shared):
    """The other columns of each batch, with what its texts (``_text``) hold of the windows."""
    b = shared.value
    table = _Table(b["token"])
    names = b["names"]
    for batch in _text.pieces(batches, "_text"):
        h, first, doc = _words(batch, batch.schema.get_field_index("_text"))
        found: list = []
        for k in b["widths"]:
            if len(h) < k or not len(table.keys):
                continue
            at, key = table.find(_text.grams(h, k))
            inside = doc[at] == doc[at + k - 1]
            at, key = at[inside], key[inside]
            n = b["last"][key] - b["first"][key]
            win = _text.ragged(b["first"][key], n)
            at = np.repeat(at, n)
            d = doc[at] if len(at) else at
            start = at - b["offset"][win]
            end = start + b["size"][win]
            ok = (b["width"][win] == k) & (start >= first[d]) & (end <= first[d + 1])
            win, start, end, d = win[ok], start[ok], end[ok], d[ok]
            ok = _text.whole(h, start, end) == b["hash"][win]
            found.append((d[ok], start[ok], end[ok], win[ok]))
        d, s, e, win = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        n = b["items_to"][win] - b["items_at"][win]
        pair = np.unique(np.stack([np.repeat(d, n), b["items"][_text.ragged(b["items_at"][win], n)]]), axis=1)
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, s, 1)
        np.add.at(cover, e, -1)
        breaks = np.ones(len(h), bool)
        breaks[1:] = doc[1:] != doc[:-1]
        at, size = _text.runs(np.cumsum(cover)[:-1] > 0, breaks)
        hits: list = [[] for _ in range(batch.num_rows)]
        for x, y in zip(at.tolist(), size.tolist()):
            i = int(doc[x])
            hits[i].append({"s": x - int(first[i]), "e": x - int(first[i]) + y})
        items: list = [[] for _ in range(batch.num_rows)]
        for i, x in pair.T.tolist():
            items[i].append(names[x])
        more = [pa.array(np.diff(first)), pa.array(hits, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
        keep = [i for i, c in enumerate(batch.schema.names) if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *more], [*[batch.schema.names[i] for i in keep], "_words", "_hits", "_items"])


def _index(rows, widths: list[int], rare: dict) -> dict:
    """The prefix index of a block's windows: by token, the windows of which it is the rarest."""
    names = sorted({r["item"] or "" for r in rows})
    number = {x: i for i, x in enumerate(names)}
    windows: dict = {}
    for r in rows:
        windows.setdefault((r["size"], r["hash"]), (r["tokens"], set()))[1].add(number[r["item"] or ""])
    entry = []
    for (size, h), (tokens, items) in windows.items():
        at = min(range(len(tokens)), key=lambda i: (rare.get(tokens[i], 0), tokens[i], i))
        entry.append((tokens[at] % (1 << 64), at, size, size - len(tokens) + 1, h, sorted(items)))
    entry.sort(key=lambda x: x[0])
    token = np.array([x[0] for x in entry], U)
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
    count = np.array([len(x[5]) for x in entry], np.int64)
    to = np.cumsum(count)
    return {
        "token": token[first], "first": first, "last": np.append(first[1:], len(token)) if len(token) else first,
        "offset": np.array([x[1] for x in entry], np.int64), "size": np.array([x[2] for x in entry], np.int64), "width": np.array([x[3] for x in entry], np.int64),
        "hash": np.array([x[4] for x in entry], np.int64).view(U), "items": np.array([i for x in entry for i in x[5]], np.int64), "items_at": to - count, "items_to": to,
        "names": names, "widths": widths,
    }


def _cells(batches):
    """(cell, bits) of the cells of a bitmap that a task holds."""
    held: dict = {}
    for batch in batches:
        cell, at = (c.to_numpy() for c in batch.columns)
        order = np.argsort(cell, kind="stable")
        cell, at = cell[order], at[order]
        cut = np.flatnonzero(np.diff(cell, prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(cell))):
            bits = held.setdefault(int(cell[a]), np.zeros(CELL, U))
            np.bitwise_or.at(bits, at[a:b] >> 6, U(1) << (at[a:b] & 63).astype(U))
    for cell, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([bits.tobytes()], pa.binary())], ["cell", "bits"])


def _bitmap(tokens: DataFrame):
    """A broadcast bitmap of a table of longs; a token's bit may be set by others."""
    spark = tokens.sparkSession
    size = BITS_EACH * max(tokens.count(), 1)
    words = 1 << max(10, min(size.bit_length() - 6, BITS.bit_length() - 7))
    place = F.col("token").bitwiseAND(64 * words - 1)
    cells = tokens.select(F.shiftright(place, CELL.bit_length() + 5).alias("cell"), place.bitwiseAND(64 * CELL - 1).alias("at"))
    with _store.cleaned(spark):
        got = cells.repartition(_store.tasks(spark), "cell").mapInArrow(_cells, "cell long, bits binary").collect()  # BITS at most
    bits = np.zeros(max(words, CELL), U)
    for r in got:
        bits[r["cell"] * CELL : (r["cell"] + 1) * CELL] = np.frombuffer(r["bits"], U)
    bits = bits[:words]
    return spark.sparkContext.broadcast(bits)


def _set(bits: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Places of the tokens whose bit is set."""
    at = (token & U(64 * len(bits) - 1)).astype(np.int64)
    return np.flatnonzero((bits[at >> 6] >> (token & U(63))) & U(1))


def _shared(batches, bits, widths: list[int]):
    """(token, documents) of a chunk's tokens that the bitmap may hold."""
    for batch in _text.pieces(batches):
        h, _, doc = _words(batch, 0)
        for k in widths:
            token = _text.grams(h, k)
            at = _set(bits.value, token)
            at = at[doc[at] == doc[at + k - 1]]
            pair = np.unique(np.stack([token[at], doc[at].astype(U)]), axis=1)[0]
            if len(pair):
                first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(pair[first].view(np.int64)), pa.array(np.diff(np.append(first, len(pair))))], ["token", "n"])


def _places(batches, bits, widths: list[int], span: int):
    """Places of the prefix tokens: (token, width, document's key, place, place of the first word around it, their hashes)."""
    for batch in _text.pieces(batches, "_text"):
        h, first, doc = _words(batch, 2)
        ids, ths = (batch.column(i).to_numpy() for i in (0, 1))
        for k in widths:
            token = _text.grams(h, k)
            at = _set(bits.value, token)
            at = at[doc[at] == doc[at + k - 1]]
            if not len(at):
                continue
            d = doc[at]
            low, high = np.maximum(first[d], at - span), np.minimum(first[d + 1], at + span + k)
            around = [h[a:b].tobytes() for a, b in zip(low, high)]
            columns = [token[at].view(np.int64), np.full(len(at), k), ids[d], ths[d], at - first[d], low - first[d]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(around, pa.binary())], ["token", "width", "_di", "_dt", "at", "low", "around"])


def _verified(batches):
    """The candidates whose whole window is there: (_di, _dt, s, e, size, hash)."""
    for batch in batches:
        di, dt, at, low, offset, size, want = (batch.column(c).to_numpy() for c in ("_di", "_dt", "at", "low", "offset", "size", "hash"))
        data, offs = _text.buffer(batch.column("around"))
        h, begin, end = np.frombuffer(data.tobytes(), "<u8"), offs[:-1] // 8, offs[1:] // 8
        s = begin + at - low - offset
        ok = np.flatnonzero((s >= begin) & (s + size <= end))
        ok = ok[_text.whole(h, s[ok], s[ok] + size[ok]) == want[ok].view(U)]
        start = at[ok] - offset[ok]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (di[ok], dt[ok], start, start + size[ok], size[ok].astype(np.int64), want[ok])], ["_di", "_dt", "s", "e", "size", "hash"])


def _counted(batches):
    """The other columns of each batch, with how many words its texts (``_text``) have."""
    for batch in _text.pieces(batches, "_text"):
        data, offs = _text.buffer(batch.column("_text"))
        _, _, first = _text.spans(data, offs, _text.SYMBOL)
        keep = [i for i, c in enumerate(batch.schema.names) if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(np.diff(first))], [*[batch.schema.names[i] for i in keep], "_words"])


def _joined(docs: DataFrame, windows: DataFrame, kept: _store.Kept, span: int) -> DataFrame:
    """mark() for any number of windows, which are a table."""
    n = _store.tasks(docs.sparkSession)
    whole = windows.groupBy("size", "hash").agg(F.first("tokens").alias("tokens"))
    whole = _store.written(whole.withColumn("width", (F.col("size") - F.size("tokens") + 1).cast("long")), "windows")
    widths = sorted(r["width"] for r in whole.select("width").distinct().collect())  # at most WIDTH
    tokens = _store.written(whole.select(F.explode("tokens").alias("token")).distinct(), "tokens")
    some = _bitmap(tokens)
    counts = docs.select("text").mapInArrow(lambda b: _shared(b, some, widths), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).join(tokens, "token")
    each = whole.select("size", "hash", "width", F.posexplode("tokens").alias("offset", "token")).join(counts, "token", "left")
    rarest = each.groupBy("size", "hash", "width").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("x")).select("size", "hash", "width", "x.*")
    prefix = _store.written(rarest.where("n > 0").withColumn("offset", F.col("offset").cast("long")), "prefix")
    rare = _bitmap(prefix.select("token").distinct())

    key = {"_di": F.xxhash64("doc_id"), "_dt": F.xxhash64("text")}
    source = docs.select(*[x.alias(c) for c, x in key.items()], F.col("text").alias("_text"))
    near = source.mapInArrow(lambda b: _places(b, rare, widths, span), "token long, width long, _di long, _dt long, at long, low long, around binary")
    near = _store.written(near, "places")
    often = max(1000, 2 * near.count() // n)
    met = _store.met(near.withColumnRenamed("width", "w"), prefix, "token", often).where("w = width")
    hits = met.mapInArrow(_verified, "_di long, _dt long, s long, e long, size long, hash long")
    hits = _store.written(hits.distinct(), "hits")
    stretches = hits.groupBy("_di", "_dt").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("_hits"))
    items = hits.select("_di", "_dt", "size", "hash").distinct().join(windows.select(F.col("size").cast("long").alias("size"), "hash", "item").distinct(), ["size", "hash"])
    items = items.groupBy("_di", "_dt").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    found = _store.written(stretches.join(items, ["_di", "_dt"]).withColumnsRenamed({"_di": "_fi", "_dt": "_ft"}), "found")
    _store.dropped(windows, whole, tokens, prefix, near, hits)
    every = kept.given(docs, *[x.alias(c) for c, x in key.items()], F.col("text").alias("_text"))
    every = every.mapInArrow(_counted, kept.shape("_di long, _dt long, _words long"))
    out = every.join(found, (F.col("_di") == F.col("_fi")) & (F.col("_dt") == F.col("_ft")), "left")
    none = lambda c: F.array().cast(found.schema[c].dataType)
    return kept.back(out, "_words", F.coalesce("_hits", none("_hits")).alias("_hits"), F.coalesce("_items", none("_items")).alias("_items"))


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str], span: int = SPAN, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns ``keep`` of each document, with ``_words``, ``_hits`` (stretches of words, which may overlap) and ``_items``.

    A kept column with a name of ``OWN`` comes back with an underscore behind it.
    """
    kept = _store.Kept(docs, keep, OWN)
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    windows = _store.written(items.mapInArrow(lambda b: _windows(b, span, width), "item string, size int, hash long, tokens array<long>"), "windows")
    if windows.count() > block_words:
        return _joined(docs, windows, kept, span)
    rows = windows.collect()
    _store.dropped(windows)
    widths = sorted({r["size"] - len(r["tokens"]) + 1 for r in rows})
    tokens = sc.broadcast(np.unique(np.array([t for r in rows for t in r["tokens"]], np.int64).view(U)))
    with _store.cleaned(docs.sparkSession):
        rare = docs.select("text").mapInArrow(lambda b: _frequencies(b, tokens, widths), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    index = sc.broadcast(_index(rows, widths, dict(zip(rare["token"].tolist(), rare["n"].tolist()))))
    found = kept.given(docs, F.col("text").alias("_text")).mapInArrow(lambda b: _match(b, index), kept.shape(_HITS))
    return kept.back(found, "_words", "_hits", "_items")


def contamination(marked: DataFrame) -> DataFrame:
    """``n_words``, ``n_hit``, ``items`` and ``contaminated`` by the contract's rule, from mark()'s columns."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(
        F.sort_array("_hits"), zero, lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"]
    )
    out = marked.withColumn("n_hit", covered).withColumnRenamed("_words", "n_words")
    return out.withColumns({"items": F.sort_array("_items"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))}).drop("_hits", "_items")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(mark(docs, items, ["doc_id"]))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def brute(docs, items, span: int = SPAN) -> dict:
    """The same by a dictionary of windows, for tests."""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict = {}
    for name, t in items:
        w = word.findall((t or "").encode().lower())
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w = word.findall((t or "").encode().lower())
        hit, held = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i : i + n])):
                    hit[i : i + n] = [True] * n
                    held |= x
        k = sum(hit)
        out[d] = (len(w), k, len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), k > 0 and 20 * k >= len(w))
    return out
