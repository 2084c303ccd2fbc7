"""Language identification by rank-order profiles.

A profile is a ranking of the most frequent letter n-grams (1 to 3 letters, word ends included). A
text's distance to a language is the sum of how far each of its n-grams is out of place there; n-grams
that the language's profile lacks count the profile's length. The nearest language is predicted.

Profiles are learned from labelled texts that are not held out; of more than ``SAMPLE`` a language, a
share chosen by a hash of the id and the text, of about that many. Counting is distributed; only the
profiles (``SIZE`` n-grams of each language that is learned, however many) are broadcast, as lists by n-gram.

Defined results: a text that is null or has no letter (by Unicode, as ``str.isalpha``) is ``und`` with score 0;
n-grams of equal count share their mean rank, in texts and in profiles; of equally near languages the first by name is predicted; a null doc_id is held
in; repeated rows are predicted alike; without any labelled text everything is ``und``; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _store, _text

SIZE = 400
SAMPLE = 3000
UNKNOWN = "und"
_state: dict = {}


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter + 1, or 1 for all that isn't a letter; made once a worker."""
    if "table" not in _state:
        table = np.ones(0x110000, np.uint32)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                table[ord(c)] = ord(c.lower()[0]) + 1
        _state["table"] = table
    return _state["table"]


def grams(text: str | None) -> np.ndarray:
    """Packed n-grams of a text; none if it has no letter."""
    if not text:
        return np.zeros(0, np.uint64)
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    word = x != 1
    if not word.any():
        return np.zeros(0, np.uint64)
    keep = word.copy()  # each run of letters, and one end before the next
    keep[1:] |= word[:-1]
    x = np.concatenate(([1], x[keep], [1])).astype(np.uint64)
    two = x[:-1] << np.uint64(21) | x[1:]
    three = two[:-1] << np.uint64(21) | x[2:]
    middle = x[1:-1]
    return np.concatenate((middle[middle != 1], two[two != (1 << 21 | 1)], three[middle != 1]))


def counts(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(new)
    return g[first], np.diff(np.append(first, len(g)))


def _mean_ranks(n: np.ndarray) -> np.ndarray:
    """Ranks of counts in falling order; equal ones share their mean."""
    first = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
    size = np.diff(np.append(first, len(n)))
    return np.repeat(first + (size - 1) / 2, size)


def ranking(g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams and their ranks; those of equal count share the mean rank."""
    key, n = counts(g)
    order = np.lexsort((key, -n))[:size]
    return key[order], _mean_ranks(n[order])


class Profiles:
    """The languages, and by n-gram the languages that have it in their profile, with its rank there."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, rank: np.ndarray):
        order = np.lexsort((lang, gram))
        self.langs, self.lang, self.rank = langs, lang[order], rank[order]
        self.keys, self.first = np.unique(gram[order], return_index=True)
        self.last = np.append(self.first[1:], len(gram))

    def distances(self, text: str | None, size: int) -> np.ndarray | None:
        """Mean out-of-place distance to each language, as a share of the largest."""
        g = grams(text)
        if not len(g) or not self.langs:
            return None
        key, rank = ranking(g, size)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == key)
        first, n = self.first[at[known]], (self.last - self.first)[at[known]]
        there = _text.ragged(first, n)
        nearer = size - np.minimum(np.abs(self.rank[there] - np.repeat(rank[known], n)), size)
        return 1 - np.bincount(self.lang[there], nearer, len(self.langs)) / (size * len(key))


def _tally(batches):
    """(lang, gram, n) of the texts of a task."""
    held: dict = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key, n = counts(grams(text))
            held.setdefault(lang, []).append((key, n))
        for lang, parts in held.items():
            key, n = (np.concatenate(x) for x in zip(*parts))
            if len(key):
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                held[lang] = [(key[first], np.add.reduceat(n, first))]
    for lang, parts in held.items():
        for key, n in parts:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def profiles(labelled: DataFrame, size: int = SIZE, sample: int = SAMPLE) -> Profiles:
    """Learned from (doc_id, lang, text)."""
    labelled = labelled.where("lang is not null")
    share = labelled.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    unit = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    chosen = labelled.join(F.broadcast(share) if share.count() <= 100_000 else share, "lang").where(unit < F.col("share"))
    n = chosen.select("lang", "text").mapInArrow(_tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = n.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    with _store.cleaned(labelled.sparkSession):
        top = top.toPandas().sort_values(["lang", "r"])
    langs = sorted(set(top["lang"]))
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in top["lang"]], np.int64)
    rank = np.concatenate([_mean_ranks(top["n"].to_numpy()[lang == i]) for i in range(len(langs))]) if langs else np.zeros(0)
    return Profiles(langs, lang, top["gram"].to_numpy(np.int64).view(np.uint64), rank)


def best(text: str | None, model: Profiles, size: int = SIZE) -> tuple[str, float]:
    far = model.distances(text, size)
    if far is None:
        return UNKNOWN, 0.0
    i = int(far.argmin())
    return model.langs[i], float(min(max(1 - far[i], 0.0), 1.0))


def predict(docs: DataFrame, model, keep: list[str], size: int = SIZE) -> DataFrame:
    """The columns ``keep`` with ``_lang`` and ``_score``; only the text decides. A kept column of one of these names gets an underscore behind it."""
    spark = docs.sparkSession
    kept = _store.Kept(docs, keep, ["_lang", "_score"])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = [best(t, shared.value, size) for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()]
            names = [x for x in batch.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in names], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*names, "_lang", "_score"])

    return kept.back(kept.given(docs, F.col("text").alias("_text")).mapInArrow(run, kept.shape("_lang string, _score double")), "_lang", "_score")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame):
    return profiles(docs.where(~held_out()).select("doc_id", "lang", "text"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, learn(docs), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
