"""The change applier, phrases and packing, against plain versions; and licenses in chains."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import zlib

import numpy as np
import pytest

from orderloom.llm import licenses, packing, phrases, sequenced

KIND = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double, cid int, first string, batch string"


def changes(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], KIND)


def plain(df):
    names = [f.split(" ")[0] for f in KIND.split(", ")][:9]
    return [r.asDict() for r in df.select(*names).distinct().collect()]


def digest(df):
    cents = lambda b: None if b is None else int(np.floor(100 * b + 0.5))
    return sorted((r.change_id, r.client_id, r.status, r.batch, r.missed, r.city, cents(r.balance), r.current) for r in df.collect())


def test_changes_of_a_huge_client_and_awkward_rows(spark):
    """One client with numbers over many pages, gaps, repeats and late rows; null ids, ops, cities and balances; repeated rows."""
    dice, rows = random.Random(5), []
    day = dt.datetime(2024, 1, 1)
    for i in range(900):
        seq = max(0, i // 2 + dice.randint(-6, 6)) * 3
        client = dice.choice([1, 1, 1, 2, None])
        valid = None if dice.random() < 0.02 else day + dt.timedelta(days=i // 7 + dice.choice([0, 0, 0, 20]) - 2)
        rows.append((i, client, seq, dice.choice(["I", "U", "U", "U", "D", None, "?"]), valid, "s", "t", dice.choice(["a", "b", None]), dice.choice([1.005, -2.5, None, 7.0])))
    rows += rows[:50] + [(None, 1, 1, "I", day, "s", "t", "c", 1.0), (5000, 9, None, "I", day, "s", "t", "c", 1.0), (5001, 9, 0, "U", day, "s", "t", None, None)]
    df = changes(spark, rows).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(f"{sequenced._STATE}.unloadOnCommit", None)
    got = digest(sequenced.apply_changes(df, batches=4, days=140))
    assert got == sequenced.brute(plain(df), batches=4, days=140)
    assert len(got) > 700 and {r[2] for r in got} == {"applied", "rejected"} and max(r[3] for r in got) == 5 and any(r[4] for r in got)
    assert before == (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(f"{sequenced._STATE}.unloadOnCommit", None))


def test_each_start_frees_the_driver(spark):
    """A whole collection after each of the two starts, so that what they leave doesn't grow the driver's heap."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    df, before = changes(spark, [(i, 1, i, "I", dt.datetime(2024, 1, 1), "s", "t", "a", 1.0) for i in range(5)]), whole()
    assert sequenced.apply_changes(df, batches=1).count() == 5
    assert whole() >= before + 2


def test_starts_are_few_jobs_and_ids_stay_whole(spark):
    """A start is a write, one shuffle to the state and a row a range that comes back, whatever is held; and ids pass pandas as whole numbers."""
    jobs, dice, day = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs, random.Random(8), dt.datetime(2024, 1, 1)
    rows = [(2**60 + i, 2**61 + (i % 5 == 0) * dice.randint(1, 9), max(0, i + dice.randint(-40, 40)), dice.choice("IUUUD"), day + dt.timedelta(days=i // 4), "s", "t", "a", 1.0) for i in range(400)]
    df, ran = changes(spark, rows), []
    for batches in (1, 4):
        before, got = jobs(), sequenced.apply_changes(df, batches=batches, days=140)
        ran.append(jobs() - before)
        assert digest(got) == sequenced.brute(plain(df), batches=batches, days=140)
    assert ran[1] - ran[0] <= 3 * 8


def test_pointers_of_a_client_over_several_ranges():
    """Against the numbers themselves: the first one that isn't held, and the first one behind the largest that is due."""
    dice = random.Random(2)
    for _ in range(300):
        top, p = dice.randint(1, 30), dice.randint(0, 12)
        held = {m: dice.randint(0, 9) for m in range(p, top) if dice.random() < 0.8}
        cuts = [0, *sorted(dice.sample(range(1, top), min(top - 1, dice.randint(0, 4)))), sequenced.ALL]
        ranges = []
        for lo, end in itertools.pairwise(cuts):
            own = np.array(sorted(m for m in held if lo <= m < end), np.int64)
            days = np.array([held[m] for m in own.tolist()], np.int64)
            facts = sequenced._facts(own * 0, own, days, np.maximum(p, lo) + own * 0, 3)
            ranges.append((lo, end, *([int(x[0]) for x in facts[1:]] if len(own) else (None, -1, -1))))
        q = next(m for m in itertools.count(p) if m not in held)
        due = max((m for m, d in held.items() if d <= 3), default=-1)
        assert sequenced._moved(p, ranges) == (q, next(m for m in itertools.count(due) if m not in held) if due >= q else q)


def test_changes_of_an_empty_table(spark):
    assert sequenced.apply_changes(changes(spark, []).limit(0), batches=1).count() == 0


PHRASES = [("en", "A b c. A b\tc  d, a B"), ("en", None), (None, "x y x y x y"), ("und", "x y"), ("de", "a-b c; ä ö a-b c"), ("en", "a b c"), ("de", ""), ("en", "...\n,")]


@pytest.mark.parametrize("ratio", [100, 60])
def test_phrases(spark, ratio):
    rows = PHRASES * 3 + [("en", " ".join(random.Random(3).choices("abcde", k=4000)))]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "lang string, text string, n int, words string").repartition(3)
    for least, top in ((2, 2000), (3, 4)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, ratio=ratio, top=top).collect())
        assert got == sorted(phrases.brute(rows, least=least, ratio=ratio, top=top)) and got
    assert phrases.collocations(df.limit(0)).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    a = spark.createDataFrame([("x", 0, None, 4 * 10**12), ("x", 1, "p", 10**10), ("x", 1, "q", 3 * 10**10), ("x", 2, "p q", 9 * 10**9)], "lang string, size int, phrase string, f long")
    import unittest.mock as mock

    with mock.patch.object(phrases, "phrase_counts", lambda *_: a):
        r = phrases.collocations(a).first()
    assert r.score == 1000 * 9 * 10**9 * 4 * 10**12 // (10**10 * 3 * 10**10)


TEXTS = [None, "", "Hello, WORLD's end...", "don't stop now 'Tis 12,5", "<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>", "Å ﬁne ΣΑΣ İx", "word " * 5000, "a" * 300, "x.y.z ... ,,a b　c", "tie one", "tie one"]


@pytest.mark.parametrize("words", [True, False])
def test_packing(spark, words):
    rows = [(i if i % 4 else None, t, 1, "y") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int, seq string").repartition(2)
    packed = packing.pack_documents(df, words=words, ids=True, capacity=512)
    got = packed.collect()
    tokenizer = packing._tokenizer(packing.vocabulary()).tokenizer
    want = []
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i or -1, k, 512 * k, ids[512 * k : 512 * (k + 1)]) for k in range(-(-len(ids) // 512))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.ids) for r in got) == sorted(want)
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    for s in packing.sequences(packed).collect():
        own = sorted((r.offset, r.ids) for r in got if r.sequence_id == s.sequence_id)
        assert s.ids == [x for _, ids in own for x in ids] and s.starts == [o for o, _ in own] and len(s.ids) <= 512
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_groups_exchange_what_they_cannot_fill(spark):
    """Small groups leave gaps that their bounds tell; after exchanges hardly any sequence is above the bound of all."""
    dice = np.random.default_rng(1)
    sizes = dice.integers(1, 700, 6000)
    rows = [(i, 0, 0, int(s), int(s) * 31 % 97, i % 5, i) for i, s in enumerate(sizes)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _nth long")
    out = packing.pack(pieces, group=200)
    one = packing.bound_of(packing.pack(pieces, group=200, rounds=1))
    many = packing.bound_of(out)
    assert many["bound"] <= many["used"] <= many["bound"] + 2 and many["used"] < one["used"]
    assert sorted((r.doc_id, r.length) for r in out.collect()) == [(i, int(s)) for i, s in enumerate(sizes)]
    ends = {}
    for r in sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY


def least_bins(sizes, capacity):
    """The least number of sequences by trying all ways."""
    best = [len(sizes)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                put(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best[0]


def test_bounds_never_pass_the_best():
    dice, tight = random.Random(2), 0
    for _ in range(150):
        sizes = sorted((dice.randint(1, 12) for _ in range(dice.randint(1, 8))), reverse=True)
        best, bound = least_bins(sizes, 12), packing.lower_bound(np.bincount(sizes, minlength=13), 12)
        _, _, used = packing.best_fit(np.array(sizes), 12)
        assert bound <= best <= used
        tight += bound == best
    assert tight > 130


def test_a_suppressed_license_suppresses_nothing(spark):
    table = [("A", "a", 1, 0.5, "a b"), ("B", "b", 2, 0.5, "b c"), ("C", "c", 3, 0.5, "c d"), ("L", "x", 1, 0.5, "x y z"), ("Y", "y", 1, 0.5, "y"), ("Z", "z", 5, 0.5, "z w")]
    texts = ["a b c d", "a b c", "b c d", "x y z", "x y z w", "a b c d x y z w a b", "y y", ""]
    want = ["A,C", "B", "C", "L", "Y,Z", "A,C,Y,Z", "Y", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df, {"no such base": "n"}, table).collect()}
    assert [got[i] for i in range(len(texts))] == want
    words = "abcdxyzw"
    many = [" ".join(p) for p in itertools.islice(itertools.product(words, repeat=5), 0, 32768, 23)]
    df = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(df, {"no such base": "n"}, table).collect()}
    assert got == {i: licenses.brute(t, {"no such base": "n"}, table) for i, t in enumerate(many)}
