"""Phrase collocation mining.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. All 1..``longest``-grams
within pieces become rows (lang, size, phrase, count), which Spark adds up by language and phrase. Phrases of two words or more
that occur ``least`` times are candidates. Each is cut after every word; joins on its prefix and suffix give their
counts, and the cut's score is floor(1000 * a * n / (l * r)) in decimals, by whole division. The lowest-scoring cut counts. A
phrase goes where a candidate of one word more holds it about as often (``ratio`` percent); that covers longer ones, too,
since what lies between occurs at least as often as the longer one.

* Occurrences of one phrase are added up within a chunk of text before the shuffle, so a very common phrase costs a row a chunk.
* A first pass counts pairs of words by hash. Only n-grams whose neighbouring words all are frequent pairs can be frequent; the
  others of two words or more give no row. That loses no candidate: the frequent pairs are kept as a bitmap of fixed size
  (``BITS``), which passes each of them, and counts come from the phrases themselves. Where the bitmap is full, more rows are shuffled.
* A language's top phrases are found in salted groups first, so no task sorts all phrases of one language.

Defined results: a null text is empty; a null lang is ``und`` (one with texts so labelled); repeated rows count as often as they
come; texts without words add nothing; an empty table gives an empty result; ids and other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _store, _text
from ._text import U

LONGEST = 5
LEAST = 100
RATIO = 100
TOP = 2000
UNKNOWN = "und"
#: 64-bit words of the bitmap of frequent pairs.
BITS = 1 << 20
#: Groups of a language's phrases, in which its total is met and its top phrases are found first; bytes of text a task works on at once.
SALTS = 64
CHUNK = 2 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True


class Words:
    """The words of a chunk of texts: bytes, spans, hashes, and where neighbours belong to one piece."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        data, offs = _text.buffer(text)
        self.data = _text.FOLD[data]
        self.start, self.end, first = _text.spans(data, offs, _BLANK | _STOP)
        self.hash = _text.word_hashes(data, self.start, self.end, fold=True)
        codes = pc.fill_null(lang, UNKNOWN).dictionary_encode()
        self.langs = codes.dictionary.to_pylist()
        self.lang = np.repeat(codes.indices.to_numpy(zero_copy_only=False), np.diff(first))
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in self.langs], U)
        self.salt = salt[self.lang] if len(salt) else np.zeros(0, U)
        piece = np.cumsum(_STOP[data])[self.start] if len(data) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.next = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each place on, with their language."""
        h = self.hash if n == 1 else _text.grams(self.hash, n)
        return _text.mix(h + self.salt[: len(h)])

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The ``n`` words from each of the places on, joined by one space."""
        words = (at[:, None] + np.arange(n)).reshape(-1)
        inner = np.tile(np.arange(n) < n - 1, len(at))
        lens = self.end[words] - self.start[words] + inner
        out = self.data[_text.ragged(self.start[words], lens)]
        to = np.cumsum(lens)
        out[to[inner] - 1] = 32
        offs = np.concatenate(([0], to[n - 1 :: n])).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offs.tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


def _chunks(batches):
    for batch in _text.pieces(batches, limit=CHUNK):
        words = Words(batch.column(0), batch.column(1))
        if len(words.hash):
            yield words


def _pairs(batches):
    """(k, n): hashes of neighbouring words and how often a chunk has them."""
    for words in _chunks(batches):
        k, n = np.unique(words.grams(2)[words.next], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["k", "n"])


def _rows(batches, longest: int, bits):
    """(lang, size, phrase, n) of a chunk; size 0 is the number of all words."""
    bitmap = bits.value
    for words in _chunks(batches):
        pair = words.grams(2)
        often = words.next & ((bitmap[(pair >> U(6)).astype(np.int64) % len(bitmap)] >> (pair & U(63))) & U(1)).astype(bool)
        count = np.bincount(words.lang, minlength=len(words.langs))
        yield _batch(words.langs, np.flatnonzero(count), 0, pa.nulls(int((count > 0).sum()), pa.string()), count[count > 0])
        live = np.ones(len(words.hash), bool)
        for n in range(1, longest + 1):
            if n > 1:
                live = live[:-1] & often[n - 2 :]
            at = np.flatnonzero(live)
            if not len(at):
                break
            _, first, count = np.unique(words.grams(n)[at], return_index=True, return_counts=True)
            at = at[first]
            yield _batch(words.langs, words.lang[at], n, words.phrases(at, n), count)


def _batch(langs, lang, size, phrase, n) -> pa.RecordBatch:
    names = pa.array(langs, pa.string()).take(pa.array(lang))
    return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(lang), size, np.int32)), phrase, pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "n"])


def frequent_pairs(texts: DataFrame, least: int) -> np.ndarray:
    """A bitmap that passes the hash of each pair of neighbours which occurs ``least`` times, and few others."""
    pairs = texts.mapInArrow(_pairs, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    place = (F.shiftrightunsigned("k", 6) % BITS).alias("w")
    with _store.cleaned(texts.sparkSession):
        words = pairs.select(place, F.expr("shiftleft(1L, cast(k & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap = np.zeros(BITS, U)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(U)
    return bitmap


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, f) of all phrases that occur ``least`` times; a row of size 0 holds a language's words."""
    spark = docs.sparkSession
    texts = _store.plain(docs, "lang", "text")
    bits = spark.sparkContext.broadcast(frequent_pairs(texts, least))
    rows = texts.mapInArrow(lambda b: _rows(b, longest, bits), "lang string, size int, phrase string, n long")
    counts = rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f"))
    return _store.written(counts.where((F.col("size") == 0) | (F.col("f") >= least)), "phrases")


def _part(first: str, length: str):
    return F.expr(f"array_join(slice(words, {first}, {length}), ' ')")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, ratio: int = RATIO, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, count and phrase."""
    counts = phrase_counts(docs, longest, least)
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    known = counts.where("size > 0")
    found = known.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "a", "k", _part("1", "k").alias("left"), _part("k + 1", "size - k").alias("right"))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    joined = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).withColumn("_salt", salt).join(total, ["lang", "_salt"])
    exact = {c: F.col(c).cast("decimal(18,0)").alias(c) for c in "alrn"}
    scored = joined.select("lang", "phrase", "a", "k", "l", "r", "n", (F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"]).alias("up"), (exact["l"] * exact["r"]).alias("down")).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")

    longer = found.where("size > 2").select("lang", F.col("a").alias("f"), F.explode(F.array(_part("1", "size - 1"), _part("2", "size - 1"))).alias("phrase"))
    # the most frequent extension is the one that decides
    over = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    held = best.join(over, ["lang", "phrase"], "left").where(F.col("f").isNull() | (100 * F.col("f") < ratio * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = held.withColumn("_salt", salt).withColumn("_nth", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_nth") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute(rows, longest: int = LONGEST, least: int = LEAST, ratio: int = RATIO, top: int = TOP) -> list[tuple]:
    """The same by dictionaries, for tests: rows of (lang, text)."""
    import re

    count: dict = {}
    total: dict = {}
    for lang, text in rows:
        lang = UNKNOWN if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    key = (lang, tuple(w[i : i + n]))
                    count[key] = count.get(key, 0) + 1
    out = []
    live = {k: f for k, f in count.items() if len(k[1]) > 1 and f >= least}
    for (lang, p), a in live.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(x == lang and len(q) > len(p) and inside(q) and 100 * f >= ratio * a for (x, q), f in live.items()):
            continue
        score, k = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    out.sort()
    seen: dict = {}
    result = []
    for lang, score, a, phrase, left, right in out:
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= top:
            result.append((lang, seen[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return result
