"""The registered text queries: SQL where there is some, the pipeline against its stages by brute force."""

from __future__ import annotations

import pytest

from orderloom.llm import decontaminate, jaccard_join, queries, substring_dedup

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, same, name):
    same(queries.queries()[name](spark, sf_dir), SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {d: t for d, t in texts.items() if any(c.isalpha() for c in t or "")}
    kept = {d: kept[d] for d, (_, c) in jaccard_join.brute(sorted(kept.items())).items() if c == d}
    seen: dict = {}
    split = {d: (t or "").encode().split() for d, t in kept.items()}
    for d in sorted(split):
        for i in range(len(split[d]) - 19):
            seen.setdefault(tuple(split[d][i : i + 20]), (d, i))
    cut = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - 19):
            if seen[tuple(w[i : i + 20])] < (d, i):
                gone |= set(range(i, i + 20))
        if len(gone) < len(w):
            cut[d] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else kept[d]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = decontaminate.brute(list(cut.items()), items)
    clean = {d: t for d, t in cut.items() if not bad[d][4]}
    out = p.run(spark, sf_dir).collect()
    assert {r.doc_id: r.size for r in out} == {d: len(t.encode().split()) for d, t in clean.items()}
    total = sum(r.size for r in out)
    assert abs(sum(r.taken for r in out) - 1.5 * total) < 20 and all(r.taken <= 2 * r.size for r in out)


def test_stages_keep_columns_of_documents(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == p.COLUMNS
    assert substring_dedup.LENGTH == 20


AWKWARD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "12 ?!", "en", "a", 5), (None, "plain words of a text", "en", None, 3), (None, "plain words of a text", None, None, 3), (4, "plain words of a text", "en", "b", 3),
    (5, "\u4e00\u4e8c", None, "b", 2), (6, "words of a plain text " * 4000, "en", "b", 9), (7, "one more text of plain words", None, "b", None), (7, "another text of its own, with words", "en", "a", 1), (7, "another text of its own, with words", "en", "a", 1),
]


def awkward(spark):
    rows = [(*r, "x", "y", 1) for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _lang string, hits string, _id int")


def test_language_stage_decides(spark):
    import corpus_pipeline as p

    out = [(r.doc_id, r.text, r.lang) for r in p.identify_language(spark, awkward(spark), "").collect()]
    assert {i for i, _, _ in out} == {None, 4, 6, 7} and {x for _, _, x in out} == {"en"} and len(out) == 7
    unlabelled = awkward(spark).withColumn("lang", p.F.lit(None).cast("string"))
    assert {r.doc_id for r in p.identify_language(spark, unlabelled, "").collect()} == {None, 4, 5, 6, 7}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_awkward_rows(spark, sf_dir, k):
    import corpus_pipeline as p

    name, stage = p.STAGES[k]
    out = stage(spark, awkward(spark), sf_dir).collect()
    if name == "ngram_jaccard_join":
        assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted({(0, AWKWARD[3][1]), (1, ""), (2, ""), *((d, t) for d, t, *_ in AWKWARD if d in (3, 5, 6, 7))})
    elif name == "substring_dedup":
        assert len(out) == len(AWKWARD) and next(r.text for r in out if r.doc_id == 6) == "words of a plain text"
        assert {r.text for r in out if r.doc_id != 6} == {t for d, t, *_ in AWKWARD if d != 6}
    elif name == "decontamination":
        assert len(out) == len(AWKWARD)
    elif name == "mixing":
        assert len(out) == len(AWKWARD) and all(0 <= r.taken <= 2 * r.size for r in out) and sum(r.size == 0 for r in out) == 2


def test_near_copies_of_repeated_and_null_ids(spark):
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a, "en"), (1, a, "en"), (2, a + " more", "en"), (5, b, "de"), (5, b, "en"), (5, c, "en"), (6, c, "en"), (4, c + " more", "en"), (None, d, "en"), (None, d, "en"), (9, d, "en"), (7, "", "en"), (7, "", "en")]
    df = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id or 0), r.text, r.lang) for r in p.drop_near_copies(spark, df, "").collect())
    assert got == [(0, d, "en"), (1, a, "en"), (4, c + " more", "en"), (5, b, "de"), (7, "", "en"), (7, "", "en")]
    single = p.drop_near_copies(spark, df.where("doc_id in (2, 6)"), "").collect()
    assert sorted(r.doc_id for r in single) == [2, 6]
