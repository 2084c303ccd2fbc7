"""Word boundaries and hashes against Python's own, ranges, components."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderloom.llm import _ranges, _store, _text

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 .-\t\n\x0b\x1céßŽ漢\U0001f600", max_size=40)), max_size=12)


def words_of(texts, gap, fold):
    data, offs = _text.buffer(pa.array(texts, pa.string()))
    starts, ends, first = _text.spans(data, offs, gap)
    h = _text.word_hashes(data, starts, ends, fold)
    words = [bytes(data[s:e]) for s, e in zip(starts, ends)]
    return [words[a:b] for a, b in zip(first, first[1:])], h, first


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    got, h, _ = words_of(texts, _text.SPACE, False)
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    flat = [w for x in got for w in x]
    assert len({*flat}) == len({*h.tolist()}) and len({*zip(flat, h.tolist())}) == len({*flat})
    got, h, _ = words_of(texts, _text.SYMBOL, True)
    flat = [w.lower() for x in got for w in x]
    assert [[w.lower() for w in x] for x in got] == [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower()) for t in texts]
    assert len({*zip(flat, h.tolist())}) == len({*flat}) == len({*h.tolist()})


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6))
def test_grams_tell_sequences_apart(ids, n):
    h = _text.mix(np.array(ids, np.uint64) + np.uint64(1))
    got = _text.grams(h, n)
    seqs = [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)]
    assert len(got) == len(seqs) and len({*zip(seqs, got.tolist())}) == len({*seqs}) == len({*got.tolist()})
    at = np.arange(len(seqs))
    assert (_text.whole(h, at, at + n) == got).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), max_size=30))
def test_planes_round_trip(values):
    a = np.array(values, np.uint64)
    back, at = _text.unplanes(_text.planes(a, 6), len(a), 6)
    assert (back == a).all() and at == 6 * len(a)


def test_long_words_and_blocks(monkeypatch):
    texts = ["x" * 5000 + " y", "y " + "x" * 5000]
    want = words_of(texts, _text.SPACE, False)[1].tolist()
    monkeypatch.setattr(_text, "BLOCK", 64)
    assert words_of(texts, _text.SPACE, False)[1].tolist() == want and want[0] == want[3] and want[1] == want[2]


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 5, 50, 1, 1, 1)])], ["text"])
    parts = list(_text.pieces(iter([batch, batch.slice(2, 0), batch.slice(2, 3)]), limit=10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() + batch.column(0).to_pylist()[2:5]


@pytest.mark.parametrize("chunk", [None, 25, 700])
def test_components(spark, chunk):
    rng = random.Random(4)
    edges = [(rng.randrange(200) - 100, rng.randrange(200) - 100) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000 + i, 9000) for i in range(1800)] + [(3000, 5000 + 7 * i) for i in range(200)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {r.node: r.component for r in _store.components(spark.createDataFrame(edges, "u long, v long").repartition(5), chunk=chunk).collect()}
    assert got == {v: find(v) for v in linked}
    assert _store.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ranges(spark):
    rng = random.Random(8)
    keys = [0] * 50 + list(range(1, 40)) + [10**15 + i for i in range(200)] + [-(2**63), 2**63 - 1] + [77] * 400
    rows = [(k, 5 if k == 0 else rng.randrange(-(2**63), 2**63), 1) for k in keys]
    df = spark.createDataFrame(rows, "_id long, _th long, _size long").cache()
    ends = _ranges.cuts(df, 20)
    assert ends == _ranges.cuts(df.repartition(5), 20) == sorted(set(ends))
    got = [(r._id, r._th, r.n) for r in df.withColumn("n", _ranges.number(ends)).collect()]
    assert all(n == sum(e < (i, t) for e in ends) for i, t, n in got)
    sizes = collections.Counter(n for _, _, n in got)
    assert sum(sizes.values()) == len(keys) and max(sizes[k] for k in sizes if k != next(n for i, _, n in got if i == 0)) <= 40 and len(sizes) == len(ends) + 1 >= 18
    one = _ranges.cuts(df, 20, second=None)
    assert len({e for e in one if e[0] == 77}) <= 1 and _ranges.cuts(df.limit(0), 20) == []
    assert _ranges.cuts(df.where("_id = 0"), 20) == []
