"""The text operators against brute-force versions, on documents with every kind of awkward row."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderloom.llm import _store, decontaminate, fingerprints, jaccard_join, language_id, licenses, mixing, queries, substring_dedup, toxicity, warc

KIND = "doc_id long, text string, lang string, source string, n_chars long, _id string, part string, sig string, n string, low string, c string, hits string, size string, key string, shard string, _text string"
CORE = ["doc_id", "text", "lang", "source", "n_chars"]
_rng = random.Random(3)
WORDS = ["".join(_rng.choice("abcdefghijklmnop") for _ in range(_rng.randint(1, 8))) for _ in range(600)] + ["é", "ß", "Straße", "ÉTÉ"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = prose("passage", 60)
BASE = prose("base", 200)


def edited(i, share):
    rng = random.Random(i)
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in BASE.split())


ROWS = [
    (0, None), (1, ""), (2, " \t\n\x0b "), (3, "one"), (4, "ONE"), (5, "two words"), (6, prose(1, 19)), (7, prose(1, 19)), (8, prose(2, 20)), (9, prose(2, 20)),
    (10, PASSAGE), (11, prose(3, 40) + "\n" + PASSAGE + " " + prose(4, 5)), (12, PASSAGE[:200] + "X " + PASSAGE[200:]), (13, "a b " * 100), (14, "a b " * 101), (15, "x" * 1_500_000),
    (16, prose(5, 30_000)), (17, prose(5, 30_000) + " more"), (18, "!!! ??? 123"), (19, "under the MIT License; CC-BY-NC 4.0"), (20, "Ünïcödé word line " * 10), (21, "end. " + "Apache License, Version 2.0 " * 3),
    *[(100 + i, BASE) for i in range(30)], *[(200 + i, edited(i, 0.02)) for i in range(40)], *[(300 + i, edited(i, 0.2)) for i in range(10)],
    *[(400 + i, prose(f"d{i}", 80) + " " + " ".join(PASSAGE.split()[10:40])) for i in range(10)],
]


def frame(spark, rows, source=lambda i: f"s{i % 3}"):
    full = [(i, t, "en" if i is None or i % 7 else None, source(i) if i is not None else None, len(t or "")) + ("x",) * 11 for i, t in rows]
    return spark.createDataFrame(full, KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# --- substring dedup


def digests(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(df).collect()}


def test_substrings(docs, empty):
    assert digests(substring_dedup.dedup_substrings(docs)) == substring_dedup.brute(ROWS)
    out = substring_dedup.dedup_substrings(docs, length=6, seed=3)
    assert "_id" not in out.columns and "source" in out.columns
    assert digests(out) == substring_dedup.brute(ROWS, 6)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substrings_of_repeated_rows(spark):
    twice = frame(spark, [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE)])
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.digest(substring_dedup.dedup_substrings(twice)).collect()) == [(1, 0), (1, 0), (2, 60)]
    lost = substring_dedup.dedup_substrings(spark.createDataFrame([(None, PASSAGE), (5, PASSAGE)], "doc_id long, text string"))
    assert {r.doc_id: r._removed for r in lost.collect()} == {None: 0, 5: 60}


def test_substrings_of_texts_beyond_two_bytes(spark):
    long = prose("long", 600)
    rows = [(1, " ".join([long] * 120)), (2, "start " + " ".join([long] * 120)), (3, "x " * 70_000), (4, "x " * 66_000 + "y")]
    out = frame(spark, rows).repartition(4, "doc_id")
    assert digests(substring_dedup.dedup_substrings(out)) == substring_dedup.brute(rows)


def test_common_phrase_is_dealt_by_window(spark, monkeypatch):
    phrase = " ".join(f"common{i}" for i in range(12))
    rows = [(i, " ".join([prose(f"l{i}", 25), phrase, prose(f"r{i}", 25)])) for i in range(1500)] + [(9000, prose("l3", 25) + " " + phrase)]
    table = frame(spark, rows).repartition(6)
    monkeypatch.setattr(substring_dedup, "HEAVY", 50)
    total, heavy = substring_dedup.crowded(table, 20, 8)
    assert total == sum(max(len(t.split()) - 19, 0) for _, t in rows) and 0 < heavy.sum() <= substring_dedup.CELLS / 50
    assert digests(substring_dedup.dedup_substrings(table)) == substring_dedup.brute(rows)
    anchor, win = np.full(5000, np.flatnonzero(heavy[substring_dedup._cell(np.arange(1 << 19, dtype=np.uint64))])[0], np.uint64), np.arange(5000, dtype=np.uint64)
    parts = substring_dedup._dealt(anchor, win, heavy, 40)
    assert np.bincount(parts, minlength=40).max() < 250 and len(set(substring_dedup._dealt(anchor, win, ~heavy, 40))) == 1


def test_settings_of_the_session_stay(spark, docs):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(k, None) for k in keys]
    substring_dedup.dedup_substrings(docs.limit(3)).count()
    assert before == [spark.conf.get(k, None) for k in keys]


# --- n-gram Jaccard join


@pytest.mark.parametrize("bucket", [2, 96])
def test_jaccard(docs, monkeypatch, bucket):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs).collect()}
    assert got == jaccard_join.brute(ROWS)


@pytest.mark.parametrize(("block", "bucket"), [(8, 4), (24, 96)])
def test_jaccard_large_clusters(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    rng = random.Random(6)

    def copy(base, share):
        return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in base.split())

    other = " ".join(BASE.split()[:140] + prose("tail", 60).split())
    rows = [(i, copy(BASE, rng.choice([0.005, 0.01, 0.02, 0.04]))) for i in range(160)] + [(500 + i, copy(other, rng.choice([0.005, 0.03]))) for i in range(60)]
    rows += [(900 + i, " ".join(BASE.split()[i:] + prose(f"e{i}", i).split())) for i in range(0, 60, 2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(frame(spark, rows).repartition(5)).collect()}
    assert got == jaccard_join.brute(rows) and len({c for _, c in got.values()}) > 20


def templates(count, kinds=40, take=12):
    rng = random.Random(9)
    sentences = [" ".join(f"t{i}x{j}" for j in range(9)) for i in range(kinds)]
    return [(i, " ".join(rng.sample(sentences, take))) for i in range(count)]


def test_jaccard_of_texts_from_the_same_sentences(spark, monkeypatch):
    rows = templates(600, 16) + [(9000 + i, templates(1)[0][1] + f" end{i}") for i in range(120)]
    monkeypatch.setattr(jaccard_join, "BUCKET", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK", 24)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(frame(spark, rows).repartition(5)).collect()}
    assert got == jaccard_join.brute(rows) and len({c for _, c in got.values()}) > 500


def test_sketches_lose_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 40, 104, 200, 256, 257, 400):
        sets = [np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))]
        for _ in range(60):  # sets that lose and win tokens, up to the bound and beyond
            own = sets[0][rng.random(len(sets[0])) > rng.random() * 0.25]
            own = np.unique(np.append(own, rng.integers(0, 1 << 48, rng.integers(0, n // 8 + 1), dtype=np.uint64)))
            sets += [own] if len(own) else []
        sizes = np.array([len(s) for s in sets])
        x, y = jaccard_join.sketches(np.concatenate(sets), sizes)
        order = np.argsort(sizes, kind="stable")
        u, v = jaccard_join.spanning(np.arange(len(sets), dtype=np.uint64)[order], x[order], y[order], sizes[order], 80)
        root = list(range(len(sets)))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in zip(u.tolist(), v.tolist()):
            root[find(a)] = find(b)
        for a in range(len(sets)):
            for b in range(a):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if 100 * shared >= 80 * (sizes[a] + sizes[b] - shared):
                    assert jaccard_join.near(x[a], y[a], sizes[a], x[b], y[b], sizes[b], 80) and find(a) == find(b)
        assert len(u) == len(set(u.tolist())) < len(sets)


def test_jaccard_edges(spark, empty):
    assert jaccard_join.link_documents(empty).count() == 0
    rows = frame(spark, [(5, "a b"), (3, "A  B"), (3, "A  B"), (4, None)])
    assert sorted(map(tuple, jaccard_join.link_documents(rows).collect())) == [(3, 1, 3), (3, 1, 3), (4, 0, 4), (5, 1, 3)]
    rows = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {r.n_shingles for r in jaccard_join.link_documents(rows).collect()} == {2}


# --- benchmark decontamination

ITEMS = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[20:33])), (3, "one"), (4, None), (5, "?!"), (6, "two WORDS"), (None, prose(5, 13)), (7, prose("nowhere", 30)), (7, "a b a b a b a b a b a b a b a b")]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 20])
def test_decontamination(spark, docs, empty, block):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, hash string")
    out = decontaminate.contamination(decontaminate.mark(docs, items, CORE, block_words=block))
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out.collect()}
    assert got == decontaminate.brute(ROWS, ITEMS)
    assert decontaminate.mark(empty, items, ["doc_id"]).count() == 0
    none = decontaminate.contamination(decontaminate.mark(docs, items.limit(0), ["doc_id"]))
    assert none.where("contaminated or n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 0])
def test_decontamination_of_other_ids(spark, block):
    items = spark.createDataFrame([("q1", PASSAGE), ("q2", "one two three")], "item_id string, text string")
    rows = [("a", PASSAGE, 1), ("a", PASSAGE, 1), ("a", "clean words only", 2), (None, "x " + PASSAGE, 3), ("z", None, 4), ("b", "one two three one two three", 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _di int").withColumn("_text", F.lit("y"))
    out = decontaminate.contamination(decontaminate.mark(df, items, ["doc_id", "_di"], block_words=block)).collect()
    got = sorted((r._di, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in out)
    assert got == [(1, 60, 60, "q1", True)] * 2 + [(2, 3, 0, "", False), (3, 61, 60, "q1", True), (4, 0, 0, "", False), (5, 6, 6, "q2", True)]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 0])
def test_kept_columns_of_any_name(spark, block):
    items = spark.createDataFrame([("q", PASSAGE)], "item_id string, text string")
    extra = ["_text", "_words", "_Hits", "items", "n_hit", "_keep0", "_lang", "_score", "_score_", "_di", "a`b.c"]
    df = spark.createDataFrame([("a", PASSAGE, *range(len(extra))), (None, "clean words", *range(len(extra)))], ", ".join(["doc_id string", "text string", *[f"`{c.replace('`', '``')}` int" for c in extra]]))
    keep = ["doc_id", *extra]
    got = decontaminate.contamination(decontaminate.mark(df, items, keep, block_words=block))
    assert got.columns[: len(keep)] == ["doc_id", "_text", "_words_", "_Hits_", "items_", "n_hit_", *extra[5:]]
    rows = sorted(map(tuple, got.collect()), key=lambda r: str(r[0]))
    assert [r[1 : len(keep)] for r in rows] == [tuple(range(len(extra)))] * 2 and [r[-1] for r in rows] == [False, True]
    got = language_id.predict(df, language_id.profiles(df.selectExpr("doc_id", "'x' AS lang", "text")), keep)
    assert got.columns == ["doc_id", *extra[:6], "_lang_", "_score__", *extra[8:], "_lang", "_score"] and {r[1 : len(keep)] for r in map(tuple, got.collect())} == {tuple(range(len(extra)))}
    got = toxicity.score(df, None, keep)
    assert got.columns == ["doc_id", *extra[:7], "_score__", *extra[8:], "_score"] and {tuple(r)[1:] for r in got.collect()} == {(*range(len(extra)), 0.0)}


def test_ids_that_are_no_integers_are_refused(spark):
    df = spark.createDataFrame([("a", "b", "c")], "doc_id string, text string, html string").withColumn("page_id", F.col("doc_id"))
    for run in (jaccard_join.link_documents, substring_dedup.dedup_substrings, fingerprints.fingerprint_pairs, lambda x: warc.write_archive(x.withColumn("url", F.lit("u")), "file:///none")):
        with pytest.raises(TypeError, match="must be of an integer type, not string"):
            run(df)
    assert [r.component_id for r in jaccard_join.link_documents(df.withColumn("doc_id", F.lit(3).cast("short"))).collect()] == [3]


@pytest.mark.parametrize("n", [0, 3, 100_000])
def test_bitmap(spark, n):
    tokens = [int(x) for x in np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)]
    bits = decontaminate._bitmap(spark.createDataFrame([(x,) for x in tokens], "token long")).value
    places = {x & (64 * len(bits) - 1) for x in tokens}
    assert {64 * int(w) + k for w in np.flatnonzero(bits) for k in range(64) if int(bits[w]) >> k & 1} == places
    assert len(decontaminate._set(bits, np.array(tokens, np.int64).view(np.uint64))) == n


def test_common_windows_are_met_by_broadcast(spark, monkeypatch):
    rows = [(i, prose(f"q{i}", 30) + " " + " ".join(PASSAGE.split()[i % 3 : 40])) for i in range(1300)]
    items = [(i, " ".join(PASSAGE.split()[i : i + 20])) for i in range(12)] + [(99, prose("q5", 14))]
    out = decontaminate.contamination(decontaminate.mark(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], block_words=0))
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out.collect()}
    assert got == decontaminate.brute(rows, items)


# --- mixing


def test_mixing(spark, docs, empty):
    rows = frame(spark, ROWS + [(3, "one"), (3, "one")], source=lambda i: None if i % 5 == 0 else "big" if i >= 100 else ["é", "Z", "a"][i % 3])
    blocks = mixing.mix_blocks(rows, block=16)
    got = mixing.by_document(blocks).collect()
    size = {i: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in ROWS}
    source = {r.doc_id: r.source for r in rows.collect()}
    total = collections.Counter()
    for i in [*size, 3, 3]:
        total[source[i]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(total.values()), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 2 * total[s]] or list(free)
        for s in over:
            target[s] = min(2 * total[s], share * weight[s])
            left -= target[s]
            free.remove(s)
    taken = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        assert r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(ROWS) + 2 and all(abs(taken[s] - target[s]) <= 1 for s in order)
    shards = blocks.where("taken > 0").groupBy("shard").count().collect()
    assert len(shards) == 16 and max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1
    again = mixing.by_document(mixing.mix_blocks(rows.repartition(3), block=16)).collect()
    key = lambda r: (r.doc_id, r.taken, r.shards)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.by_document(mixing.mix_blocks(empty)).count() == 0


def draws(spark, good, total, n, rows=4000):
    return spark.range(rows).select(mixing.hypergeometric(F.lit(good), F.lit(total), F.lit(n), F.col("id")).alias("x"))


def test_hypergeometric(spark):
    for good, total, n in ((300, 1000, 200), (3, 10, 10), (0, 50, 7), (7, 7, 3), (10_000, 20_000, 9000), (30_000, 70_000, 41_000), (40_000_000, 90_000_000, 50_000_000), (3 * 10**9, 10**10, 4 * 10**9)):
        mean, var, low, high = draws(spark, good, total, n).agg(F.avg("x"), F.variance("x"), F.min("x"), F.max("x")).first()
        p = good / total
        want = n * p * (1 - p) * (total - n) / max(total - 1, 1)
        assert abs(mean - n * p) <= 5 * (want / 4000) ** 0.5 + 1e-9 and max(0, n - total + good) <= low <= high <= min(n, good)
        assert var == pytest.approx(want, rel=0.15, abs=1e-9)


@pytest.mark.parametrize("inverted", [0, 1000])
def test_draws_follow_the_distribution(spark, monkeypatch, inverted):
    monkeypatch.setattr(mixing, "INVERTED", inverted)
    good, total, n, rows = 60, 150, 40, 20_000
    found = collections.Counter(r.x for r in draws(spark, good, total, n, rows).collect())
    want = {x: rows * math.comb(good, x) * math.comb(total - good, n - x) / math.comb(total, n) for x in range(n + 1)}
    common = [x for x, w in want.items() if w >= 20]
    assert sum((found[x] - want[x]) ** 2 / want[x] for x in common) < 2.5 * len(common) and len(common) > 10


@pytest.mark.parametrize("fan", [64, 4])
def test_split_is_exact(spark, fan):
    q = spark.createDataFrame([(64 * i + p, 5 + 3 * (i % 7) + p) for i in range(90) for p in range(2)] + [(9000, 1)], "key long, q long")
    cuts = {r.key: r.cuts for r in mixing.split_quotas(q, 3, fan).collect()}
    assert {k: c[-1] for k, c in cuts.items()} == {r.key: r.q for r in q.collect()}
    assert all(len(c) == 8 and c == sorted(c) and c[0] >= 0 for c in cuts.values())
    per = [sum(c[i] - (c[i - 1] if i else 0) for c in cuts.values()) for i in range(8)]
    assert max(per) - min(per) <= 1
    assert {r.key: r.cuts for r in mixing.split_quotas(q.repartition(7), 3, fan).collect()} == cuts


def test_refused_pages_leave_no_folder(spark, tmp_path):
    df = spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string")
    with pytest.raises(TypeError, match="must be of an integer type"):
        warc.write_archive(df, f"file://{tmp_path}/archive")
    assert not (tmp_path / "archive").exists()


@pytest.mark.parametrize("fan", [64, 4])
def test_draws_take_few_tasks(spark, monkeypatch, fan):
    """The draw's expression stands on tables, in as many parts as their rows need, not in a stage of the shuffle's width."""
    drawn = []
    monkeypatch.setattr(mixing, "_few", lambda t, f=mixing._few: drawn.append(f(t)) or drawn[-1])
    q = spark.createDataFrame([(64 * i + p, 5 + i + p) for i in range(90) for p in range(2)], "key long, q long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        cuts = mixing.split_quotas(q, 3, fan)
        assert "xxhash64" not in cuts._jdf.queryExecution().optimizedPlan().toString()
        assert drawn and all(d.rdd.getNumPartitions() == max(1, min(40, -(-d.count() // mixing.ROWS))) for d in drawn)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_batches_for_python_are_small(spark):
    count = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text")).mapInArrow(count, "n long")
    got = [r.n for r in _store.written(rows, "batches").collect()]
    assert sum(got) == 4000 and max(got) <= 900
    assert spark.conf.get(key, None) == before


def test_many_sources(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), f"s{int(rng.paretovariate(0.4)) % 700}é") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in mixing.by_document(mixing.mix_blocks(df, block=8)).collect()}
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += len(t.split())
    order = sorted(total)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 2.0 * sum(total.values())
    for _ in range(200):  # the share by bisection
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * total[s], mid * weight[s]) for s in order) < 1.5 * sum(total.values()) else (low, mid)
    taken = collections.Counter()
    for i, t, s in rows:
        assert got[i].target == pytest.approx(min(2 * total[s], low * weight[s]), rel=1e-6, abs=1e-6) and got[i].taken <= 2 * len(t.split())
        taken[s] += got[i].taken
    assert len(order) > 200 and all(abs(taken[s] - min(2 * total[s], low * weight[s])) <= 1 for s in order)


def test_texts_of_one_id_are_told_apart(spark):
    rows = [(1, f"{w} " * 50, "a") for w in "abcdefgh"] + [(None, "x " * 50, "a"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda d: sorted((r.taken, r.shard or 0, r.slot or 0) for r in mixing.mix_blocks(d, block=7, budget=0.4).collect())
    assert taken(df) == taken(df.orderBy(F.desc("text")).repartition(3))


# --- license scan


def test_licenses(docs, empty):
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(docs).collect()}
    assert got == {i: licenses.brute(t) for i, t in ROWS}
    assert got[19][:6] == (9, 2, 0, 4, "cc-by-nc,mit", "cc-by-nc,cc-by-nc-4.0,mit")
    assert licenses.scan(empty).count() == 0


def test_licenses_of_awkward_rows(spark):
    text = "under the MIT License " + "x " * 200_000 + "GPL-3.0 or later"
    rows = [(1, text, 5), (1, text, 5), (None, "cc by nc", 5), (None, None, 5), (2, "", None)]
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, norm int")).collect()]
    assert sorted(str(x[1:]) for x in got) == sorted(str(licenses.brute(t)) for _, t, _ in rows)
    assert sorted(x[0] or 0 for x in got) == [0, 0, 1, 1, 2]


def test_license_rules(spark):
    table = licenses.rules()
    assert len(table) > 500 and len(set(licenses._SINGLE)) == len(licenses._SINGLE) > 250 and all(re.compile(licenses._bounded(r[4])) for r in table)
    assert {"boost-1.0", "business-source-1.1"} <= {r[0] for r in table} and "bsl-1.0" not in {r[0] for r in table}
    texts = ["GNU General Public License, version 3 or later", "GNU Lesser General Public License v2.1", "GPL-2.0", "Creative Commons Attribution-NonCommercial 4.0", "the BSD 3-Clause license", "mit  licence", "Kcc by nc cc.by.nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got == {0: "gpl-3-or-later", 1: "lgpl-2.1", 2: "gpl-2", 3: "cc-by-nc-4.0", 4: "bsd-3-clause", 5: "mit", 6: "cc-by-nc"}
    with pytest.raises(ValueError):
        licenses.scan(df, {"a b a": "x"})


def expansions(pattern):
    """Texts that a rule's pattern matches: every branch, each optional part without and with."""
    import re._parser as parser

    def of(items):
        out = [""]
        for kind, arg in items:
            kind = str(kind)
            if kind == "LITERAL":
                more = [chr(arg)]
            elif kind == "IN":
                more = ["7" if str(arg[0][0]) == "CATEGORY" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
            elif kind == "BRANCH":
                more = [x for branch in arg[1] for x in of(branch)]
            elif kind == "MAX_REPEAT":
                more = [x * n for n in {arg[0], min(arg[1], arg[0] + 1)} for x in of(arg[2])]
            elif kind == "SUBPATTERN":
                more = of(arg[-1])
            else:
                assert kind == "ASSERT_NOT", kind
                more = [""]
            out = list(dict.fromkeys(a + b for a in out for b in more))
        return out

    return of(parser.parse(pattern))


def test_license_keywords_lose_no_match(spark):
    table = licenses.rules()
    texts = []
    keywords = collections.defaultdict(set)
    for label, keyword, _, _, pattern in table:
        keywords[label, pattern].add(keyword)
    for (label, pattern), some in keywords.items():
        every = expansions(pattern)
        assert len(some) == 1 and all(some <= set(x.split()) for x in every), (label, pattern)
        texts += [x.upper().replace(" ", "\n") for x in (every[0], every[-1])] + [f"Ünder {every[len(every) // 2]}; or not"]
    texts += ["BSD-3-Clause", "Dual MIT / Apache-2.0", "All\nrights reserved", "in the public\ndomain", "Creative\nCommons Attribution 4.0", "Zero-Clause BSD", "under the same terms as Perl itself", "simple replacement permits"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(df).collect()}
    assert got == {i: licenses.brute(t, table=table) for i, t in enumerate(texts)}
    assert [got[i][5] for i in range(len(texts) - 8, len(texts))] == ["bsd-3-clause", "apache-2.0", "proprietary", "public-domain", "cc-by-4.0", "0bsd", "perl", ""]
    assert all(got[i][7] for i in range(len(texts) - 8))


# --- fingerprints


def test_fingerprints(docs, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(docs).collect()}
    order = sorted(ROWS, reverse=True, key=lambda r: r[0])
    same: dict = {}
    for k, (i, t) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        edit, r = fingerprints.edited_text(t, follow), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert same.setdefault(t, r.fingerprint) == r.fingerprint and same.setdefault(edit, r.edited_fingerprint) == r.edited_fingerprint
        assert (r.near_next == 1) >= (t == follow)
    assert fingerprints.fingerprint_pairs(empty).count() == 0
    assert fingerprints.fingerprint_pairs(docs.where("doc_id = 10")).first().near_next == 1


def plain_digest(text):
    """The digest of one text with plain integers."""
    data, most = text.encode(), (1 << 32) - 1
    k, counts = [int(x) for x in fingerprints._K], [0] * 512
    for j, (a, b, c) in enumerate(fingerprints.TRIPLETS):
        for p in range(len(data) - c):
            h = (data[p + a] + 1) * k[0] & most
            h = (h ^ h >> 15) + (data[p + b] + 1) * k[1] & most
            h = (h ^ h >> 13) * k[2] + (data[p + c] + 1) * k[3] + j * k[4] & most
            counts[((h ^ h >> 16) * k[5] & most) >> 23] += 1
    order = sorted(counts)
    code = [sum(n > order[512 * i // 4 - 1] for i in (1, 2, 3)) for n in counts]
    size = min(round(math.log(len(data)) / math.log(1.1)) + 1, 255) if data else 0
    packed = bytes(code[i] | code[i + 1] << 2 | code[i + 2] << 4 | code[i + 3] << 6 for i in range(0, 512, 4))
    return f"{size:02x}{packed.hex()}", code, size


def plain_likeness(a, b):
    far = {0: 0, 1: 1, 2: 2, 3: 6}
    body = sum(far[abs(x - y)] for x, y in zip(a[1], b[1])) / 512
    return 1 - min((body + min(max(abs(a[2] - b[2]) - 1, 0) * 0.01, 0.3)) / 0.9, 1)


def test_fingerprints_by_plain_integers(spark):
    rows = [(i, t) for i, t in ROWS if len(t or "") < 3000][:45] + [(7, "again"), (7, "again"), (7, "other"), (None, "lost"), (None, None)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _size long, fingerprint string").repartition(3)
    got = sorted(tuple(r) for r in fingerprints.fingerprint_pairs(table).collect() if r.doc_id not in (7, None))
    ids = [i for i, _ in rows]
    alone = sorted(((i, t or "") for i, t in rows if ids.count(i) == 1 and i is not None), reverse=True)
    follow = {a[0]: b[1] for a, b in zip(alone, alone[1:])}
    assert [r[0] for r in got] == [i for i, _ in reversed(alone)]
    for r in got:
        text = dict(alone)[r[0]]
        if r[0] in (8, min(follow), alone[-1][0]):  # next to repeated ids, or the last
            continue
        edit = fingerprints.edited_text(text, follow[r[0]])
        one, two, three = plain_digest(text), plain_digest(edit), plain_digest(follow[r[0]])
        assert r[3:5] == (one[0], two[0]) and r[5] == pytest.approx(plain_likeness(one, two)) and r[6] == pytest.approx(plain_likeness(one, three))
    assert fingerprints.fingerprint_pairs(table).count() == len(rows)


def test_edits_are_nearer_than_strangers(spark, sf_dir):
    got = queries.queries()["op5_fingerprints"](spark, sf_dir).where("n_chars > 200 and near_next < 1").collect()
    assert sum(r.near_edited > r.near_next for r in got) >= 0.95 * len(got) > 50


# --- language


def test_language(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.queries()["op2_language_id"](spark, sf_dir).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    model = language_id.learn(table)
    got = {r.doc_id: (r._lang, r._score) for r in language_id.predict(docs, model, CORE).collect()}
    assert {i for i, (x, _) in got.items() if x == "und"} == {0, 1, 2, 18} and all(0 <= s <= 1 for _, s in got.values())
    for i, t in ROWS[:12]:
        assert got[i] == language_id.best(t, model)
    assert language_id.predict(empty, model, ["doc_id"]).count() == 0
    assert {r._lang for r in language_id.predict(docs, language_id.profiles(empty), ["doc_id"]).collect()} == {"und"}


def plain_counts(text):
    """Letter n-grams of one to three letters by plain strings; a blank stands for a word's end."""
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
    found = collections.Counter()
    line = " " + " ".join(words) + " " if words else ""
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                found[g] += 1
    return found


def plain_ranks(found, size):
    # ties at the end of a profile are cut by the packed number of the n-gram, as in the module
    order = sorted(found.items(), key=lambda x: (-x[1], sum((ord(c) + 1 if c != " " else 1) << 21 * k for k, c in enumerate(reversed(x[0])))))[:size]
    at = collections.defaultdict(list)
    for i, (_, n) in enumerate(order):
        at[n].append(i)
    return {g: sum(at[n]) / len(at[n]) for g, n in order}


def test_rank_order_by_plain_strings(spark):
    texts = {"xx": ["abba abc", "baba", "cab éa"], "yy": ["zzz yzy", "ZY zé zzz"], "zz": ["Ωμέγα αβ", "木林 木"]}
    rows = [(i, lang, t) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)] + [(90, None, "qq"), (91, "empty", None), (92, "empty", "12 !")]
    model = language_id.profiles(spark.createDataFrame(rows, "doc_id long, lang string, text string"), size=12)
    assert model.langs == ["xx", "yy", "zz"]
    want = {lang: plain_ranks(sum((plain_counts(t) for t in ts), collections.Counter()), 12) for lang, ts in texts.items()}
    for text in ["abba", "zzy cab", "é", "Ω 木 a", "q", "zyzzy abba cab abba", "αβγ", "a" * 500, "aab"]:
        mine = plain_ranks(plain_counts(text), 12)
        far = {lang: sum(min(abs(p[g] - r), 12) if g in p else 12 for g, r in mine.items()) / (12 * len(mine)) for lang, p in want.items()}
        assert model.distances(text, 12).tolist() == pytest.approx([far[x] for x in model.langs])
        assert language_id.best(text, model, 12) == (min(sorted(far), key=far.get), pytest.approx(max(0.0, 1 - min(far.values()))))


def test_letters_are_those_of_unicode(spark):
    table = language_id._letters()
    assert all((table[c] != 1) == chr(c).isalpha() for c in [*range(0x300), *range(0x3130, 0x3200), 0x2A6DE, 0x2A6E5, 0x32010, 0x323AF, 0x323B0, 0x10FFFF])
    model = language_id.profiles(spark.createDataFrame([(1, "ja", "\U00032010木")], "doc_id long, lang string, text string"))
    assert language_id.best("\U00032010", model)[0] == "ja" and language_id.best("\U0002a6e5 1", model) == ("und", 0.0)


def test_no_language_is_left_out(spark):
    rows = [(i, f"l{i:04d}", f"{chr(0x4E00 + i)}{chr(0x6000 + i)}") for i in range(1200)] + [(5, "l0005", "\u4e05\u6005")] * 3
    model = language_id.profiles(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(model.langs) == 1200 and all(language_id.best(t, model)[0] == x for _, x, t in rows[::97])


def test_languages_of_repeated_and_long_rows(spark):
    rows = [(1, "en", "the words of a text"), (1, "en", "the words of a text"), (2, "fr", "les mots d'un texte"), (None, "fr", "les mots"), (3, None, "the words " * 50_000), (3, None, "the words " * 50_000), (None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, _lang string")
    got = [(r.doc_id, r._lang) for r in language_id.predict(df, language_id.learn(df), ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (1, "en"), (2, "fr"), (None, "fr"), (3, "en"), (3, "en"), (None, "und")], key=str)


# --- toxicity


def test_toxicity(spark, empty):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = prose(f"t{i}", 60).split()
        if toxic:
            words[rng.randrange(60)] = rng.choice(["vilest", "VILEST", "wretch"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or not toxic:
            labels.append((i, int(toxic), 1, "x"))
    table = frame(spark, rows)
    known = spark.createDataFrame(labels + [(None, 1, 1, "x"), (5, None, 1, "x")], "doc_id long, toxic int, quality int, text string")
    model = toxicity.train(table, known)
    got = {r.doc_id: r._score for r in toxicity.score(frame(spark, rows + [(9001, None), (9002, "")]), model, ["doc_id"]).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    bad, good = [got[i] for i in held if i % 6 == 0], [got[i] for i in held if i % 6]
    assert sum(x > y for x in bad for y in good) >= 0.95 * len(bad) * len(good)
    assert got[9001] == got[9002] < 0.5 and all(0 <= x <= 1 for x in got.values())
    assert toxicity.train(table, known.limit(0)) is None and toxicity.train(empty, known.limit(0)) is None
    assert {r._score for r in toxicity.score(table, None, ["doc_id"]).collect()} == {0.0}


def test_slopes_are_those_of_the_risk():
    rng = np.random.default_rng(3)
    for prior, n_pos, n_unl in ((0.1, 5, 40), (0.5, 30, 10), (0.3, 1, 1)):
        for shift in (-3, 0, 3):
            z = rng.normal(0, 2, n_pos + n_unl) + np.r_[np.full(n_pos, shift), np.zeros(n_unl)]

            def risk(z):
                """The non-negative estimate, text by text; below zero what is turned."""
                plus = sum(prior * math.log(1 + math.exp(-x)) / n_pos for x in z[:n_pos])
                rest = sum(math.log(1 + math.exp(x)) / n_unl for x in z[n_pos:]) - sum(prior * math.log(1 + math.exp(x)) / n_pos for x in z[:n_pos])
                return plus + rest if rest >= 0 else -rest

            step = 1e-5
            want = [(risk(z + step * e) - risk(z - step * e)) / (2 * step) for e in np.eye(len(z))]
            assert toxicity.slopes(1 / (1 + np.exp(-z)), n_pos, prior) == pytest.approx(want, abs=1e-6)


def test_toxicity_of_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).where(language_id.held_out()).join(labels, "doc_id").select("_score", "toxic").collect()
    bad, good = (np.array([r._score for r in got if r.toxic == k]) for k in (1, 0))
    assert len(bad) > 50 and (bad[:, None] > good[None, :]).mean() >= 0.93
    assert (bad >= 0.5).mean() >= 0.8 and (good >= 0.5).mean() <= 0.04


def test_repeated_and_null_ids_stay_within_the_samples(spark):
    rows = [(i, prose(f"n{i}", 20) + (" vilest" if i % 4 == 0 else "")) for i in range(600)] + [(None, prose(f"z{i}", 20)) for i in range(600)] + [(8, prose("same", 20) + " vilest")] * 900
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), known, positive=60, unlabelled=200)
    got = {r.doc_id: r._score for r in toxicity.score(frame(spark, rows[:600] + [(9999, "x" * 300_000)]), model, ["doc_id"]).collect()}
    bad, good = [got[i] for i in range(0, 600, 4)], [got[i] for i in range(1, 600, 4)]
    assert np.mean([x > y for x in bad for y in good]) > 0.95 and 0 <= got[9999] <= 1


def test_toxicity_offset_counts_all_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join([*prose(f"o{i}", 20).split(), *(rng.choice(["vilest", "wretch", "odious", "craven"]) for _ in range(rng.randint(1, 4) if i % 4 == 0 else i % 9 == 0))])) for i in range(1500)]
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows if i % 3], "doc_id long, toxic int")
    table = frame(spark, rows).repartition(3)
    own = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5}
    prior = sum(i % 4 == 0 for i in own if i % 3) / sum(1 for i in own if i % 3)
    for unlabelled in (150, 8000):
        got = toxicity.score(table, toxicity.train(table, known, unlabelled=unlabelled), ["doc_id"]).collect()
        scores = [r._score for r in got if r.doc_id in own]
        next_one = max(x for x in scores if x < 0.5)
        assert sum(x >= 0.5 for x in scores) <= prior * len(own) < sum(x >= next_one - 0.002 for x in scores)


# --- WARC


def want_records(rows):
    top: dict = {}
    for i, _, h in rows:
        h = (h or "").encode()
        top[h] = max(top.get(h, i), i)
    return {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), None if top[(h or "").encode()] == i else top[(h or "").encode()]) for i, _, h in rows}


def members(data):
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data)
        data = z.unused_data


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://é x/{i}", ["same", "", None, prose(i, 300), "same", "Ü\r\n\r\n" * 5][i % 6]) for i in range(150)] + [(1000, None, "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    roots = [f"{tmp_path}/{k}" for k in "ab"]
    for k, root in enumerate(roots):
        warc.write_archive(df.repartition(3 + 4 * k), f"file://{root}", roll=3000, shard_bytes=30_000)
    files = warc.local_files(roots[0])
    assert files == warc.local_files(roots[1]) and len(files) > 5
    back = warc.read_archive(spark, f"file://{roots[0]}").collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in back} == want_records(rows)
    heads = {name: [m.partition(b"\r\n\r\n")[0].decode().split("\r\n") for m in members(data)] for name, data in files.items()}
    names = collections.Counter(x for f in heads.values() for h in f for x in h if x.startswith("WARC-Record-ID"))
    assert max(names.values()) == 1 and all(h[0][1] == "WARC-Type: warcinfo" and f"WARC-Filename: {n}" in h[0] for n, h in heads.items())
    refers = {x.partition(": ")[2] for f in heads.values() for h in f for x in h if x.startswith("WARC-Refers-To: ")}
    responses = {x.partition(": ")[2] for f in heads.values() for h in f if h[1] == "WARC-Type: response" for x in h if x.startswith("WARC-Record-ID: ")}
    assert refers and refers <= responses
    text = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == text[r.page_id] for r in back if r.record_type == "response")


def test_warc_edges(spark, tmp_path):
    kind = "page_id long, url string, html string"
    empty = f"file://{tmp_path}/empty"
    assert warc.write_archive(spark.createDataFrame([], kind), empty).count() == 0 and warc.read_archive(spark, empty).count() == 0
    ties = f"file://{tmp_path}/ties"
    warc.write_archive(spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "v", "a"), (1, "w", "b")], kind), ties)
    back = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.read_archive(spark, ties).collect())
    assert back == [(-1, "revisit", 1), (1, "response", None), (1, "response", None), (1, "revisit", 1)]
    (tmp_path / "ties" / "_temporary-0-part").write_bytes(b"left")
    warc._swept(spark, ties)
    assert not [x for x in (tmp_path / "ties").iterdir() if x.name.startswith("_temporary")] and warc.read_archive(spark, ties).count() == 4


def test_warc_rows_of_one_page_are_split(spark, tmp_path):
    rows = [(7, f"u{i % 3}", prose(f"w{i % 150}", 200)) for i in range(300)] + [(None, "u", None)] * 5
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}", roll=10_000, shard_bytes=30_000)
    assert len({n[:11] for n in warc.local_files(str(tmp_path))}) >= 5
    back = warc.read_archive(spark, f"file://{tmp_path}").collect()
    assert len(back) == 305 and collections.Counter(r.record_type for r in back) == {"response": 151, "revisit": 154}


def test_warc_reads_what_the_manifest_names(spark, tmp_path):
    root = f"file://{tmp_path}"
    warc.write_archive(spark.createDataFrame([(i, "u", prose(i, 300)) for i in range(20)], "page_id long, url string, html string"), root, roll=3000)
    name, data = sorted(warc.local_files(str(tmp_path)).items())[1]
    file = tmp_path / name
    (tmp_path / "part-999999-0000.warc.gz").write_bytes(data)
    assert warc.read_archive(spark, root).count() == 20
    file.rename(tmp_path / f"_temporary-0-{name}")
    with pytest.raises(OSError, match="is missing"):
        warc.read_archive(spark, root)
    file.write_bytes(data[:-1])
    with pytest.raises(OSError, match="bytes"):
        warc.read_archive(spark, root)
