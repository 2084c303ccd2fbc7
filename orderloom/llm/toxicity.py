"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings (present or not) is trained in numpy from confirmed toxic texts and
unlabelled ones. The unlabelled hold toxic texts too, so the risk of the negative class is the risk over
unlabelled texts less what the class prior says that their toxic share contributes; where that estimate
falls below zero, its gradient is turned (non-negative estimator). The prior is the toxic share of the
labelled texts. The offset is set so that the prior's share of all texts that are not held out scores 0.5
or more, by a histogram of their margins (bins of 1 / ``BINS`` in asinh; a bin that would exceed the share stays below).

The weights are learned only from rows that are not held out, at most about ``POSITIVE`` toxic and ``UNLABELLED``
other texts, chosen by a hash of the id and the text; the words of a text are never cut. All texts are scored in full.

Defined results: null, empty and wordless texts get the score of the offset alone; a null doc_id is held
in; of repeated label rows toxic wins; repeated documents are scored alike, and counted once in the samples; without a toxic label
all scores are 0; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text
from ._text import U
from .language_id import held_out

DIMENSIONS = 1 << 18
#: Bytes of the word beginnings that are features too.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A feature is used if toxic texts hold it more often than unlabelled ones by so many standard errors.
DEVIATION = 3.0
POSITIVE = 3000
UNLABELLED = 8000
ROUNDS = 120
RATE = 0.05
DECAY = 2e-5
#: Bins of the margins' histogram a unit of asinh, and the last one; what lies beyond is counted there.
BINS = 4096
LAST = 50_000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashed words and word beginnings of all texts, one after the other, and how many each has."""
    data, offs = _text.buffer(texts)
    starts, ends, first = _text.spans(data, offs, _text.SYMBOL)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first)).astype(U)
    keys = []
    for size in (None, *BEGINNINGS):
        live = np.arange(len(starts)) if size is None else np.flatnonzero(ends - starts > size)
        at = starts[live]
        h = _text.word_hashes(data, at, ends[live] if size is None else at + size, fold=True)
        keys.append(_text.distinct(doc[live] << U(32) | (_text.mix(h + U(size or 0)) >> U(20)) & U(DIMENSIONS - 1)))
    key = _text.distinct(np.concatenate(keys))
    return (key & U(0xFFFFFFFF)).astype(np.int64), np.bincount((key >> U(32)).astype(np.int64), minlength=len(offs) - 1)


def _margin(words: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights[words])))
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def slopes(p: np.ndarray, n_pos: int, prior: float) -> np.ndarray:
    """How the risk changes with each text's margin; p: probabilities, of the toxic texts first."""
    n_unl = len(p) - n_pos
    # losses of the positive class and of the negative class: -log p, -log (1 - p)
    negative = -np.log(np.maximum(1 - p, 1e-12))
    rest = negative[n_pos:].mean() - prior * negative[:n_pos].mean()
    g = np.empty(len(p))
    if rest >= 0:
        g[:n_pos] = prior * (p[:n_pos] - 1) / n_pos - prior * p[:n_pos] / n_pos
        g[n_pos:] = p[n_pos:] / n_unl
    else:  # step back from a negative estimate
        g[:n_pos] = prior * p[:n_pos] / n_pos
        g[n_pos:] = -p[n_pos:] / n_unl
    return g


def fit(pos: tuple, unl: tuple, prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and offset of the non-negative PU risk with the logistic loss, by Adam over all given texts."""
    words, sizes = np.concatenate((pos[0], unl[0])), np.concatenate((pos[1], unl[1]))
    n_pos = len(pos[1])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    used, column = np.unique(words, return_inverse=True)
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        p = _sigmoid(_margin(column, sizes, w) + b)
        g = slopes(p, n_pos, prior)
        grad = np.append(np.bincount(column, weights=g[owner], minlength=len(used)) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    out = np.zeros(DIMENSIONS)
    out[used] = w
    return out, b


def selected(pos: tuple, unl: tuple, deviation: float = DEVIATION) -> np.ndarray:
    """Which features toxic texts hold more often than unlabelled ones, by a two-sample test of the shares."""
    a, b = (np.bincount(x[0], minlength=DIMENSIONS) for x in (pos, unl))
    n, m = max(len(pos[1]), 1), max(len(unl[1]), 1)
    p = (a + b) / (n + m)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n + 1 / m))
    return (a / n - b / m > deviation * error) & (a >= 3)


def only(x: tuple, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    live = keep[x[0]]
    return x[0][live].astype(np.int64), np.bincount(np.repeat(np.arange(len(x[1])), x[1])[live], minlength=len(x[1]))


def _blobs(batches):
    for batch in _text.pieces(batches):
        words, sizes = features(batch.column(1))
        end = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words[e - s : e].astype("<u4").tobytes() for s, e in zip(sizes, end)], pa.binary())], ["kind", "words"])


def offset(rows: DataFrame, weights: np.ndarray, prior: float) -> float:
    """The offset at which at most the prior's share of all ``rows`` scores 0.5 or more: the lowest cut between bins."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def tally(batches):
        total = np.zeros(2 * LAST + 1, np.int64)
        for batch in _text.pieces(batches, "text"):
            at = np.floor(np.arcsinh(_margin(*features(batch.column(0)), shared.value)) * BINS)
            total += np.bincount(np.clip(at, -LAST, LAST).astype(np.int64) + LAST, minlength=len(total))
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live - LAST), pa.array(total[live])], ["bin", "n"])

    got = rows.select("text").mapInArrow(tally, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    bins, n = np.array(sorted((r["bin"], r["n"]) for r in got), np.int64).reshape(-1, 2).T
    above = np.cumsum(n[::-1])[::-1]
    fits = np.flatnonzero(above <= prior * n.sum())
    # right above the last bin that doesn't fit
    first = len(bins) if not len(fits) else fits[0]
    return -float(np.sinh((bins[first - 1] + 1) / BINS)) if first else 0.0


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float] | None:
    """The model from documents and labels that aren't held out; None without toxic ones."""
    spark = docs.sparkSession
    known = labels.where(~held_out()).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not toxic:
        return None
    prior = min(max(toxic / total, 0.001), 0.5)
    unit = lambda *c: F.pmod(F.xxhash64(F.lit(11), *c), F.lit(1_000_000)) / 1_000_000
    rows = docs.where(~held_out()).select("doc_id", "text")
    ids = known.where((F.col("toxic") == 1) & (unit(F.col("doc_id")) < positive / toxic)).select("doc_id")
    pos = rows.join(F.broadcast(ids), "doc_id", "left_semi")  # about POSITIVE ids
    n, found = rows.count(), pos.count()
    some = lambda df, share: df.where(unit(F.col("doc_id"), F.xxhash64("text")) < share).distinct()
    pos, unl = some(pos, min(1.0, 1.2 * positive / max(found, 1))), some(rows, unlabelled / max(n, 1))
    parts = {}
    for kind, part in ((1, pos), (0, unl)):
        with _store.cleaned(spark):
            got = part.select(F.lit(kind).alias("kind"), "text").mapInArrow(_blobs, "kind int, words binary").select("words").collect()
        sizes = np.array([len(r["words"]) // 4 for r in got], np.int64)
        parts[kind] = (np.frombuffer(b"".join(r["words"] for r in got), "<u4"), sizes)
        del got
    keep = selected(parts[1], parts[0])
    weights, b = fit(only(parts[1], keep), only(parts[0], keep), prior)
    return weights, offset(rows, weights, prior) if n else b


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``_score``. A kept column of that name gets an underscore behind it."""
    spark = docs.sparkSession
    kept = _store.Kept(docs, keep, ["_score"])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in _text.pieces(batches, "_text"):
            names = [x for x in batch.schema.names if x != "_text"]
            if shared.value is None:
                out = np.zeros(batch.num_rows)
            else:
                weights, offset = shared.value
                out = _sigmoid(_margin(*features(batch.column(batch.schema.get_field_index("_text"))), weights) + offset)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in names], pa.array(out)], [*names, "_score"])

    return kept.back(kept.given(docs, F.col("text").alias("_text")).mapInArrow(run, kept.shape("_score double")), "_score")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
