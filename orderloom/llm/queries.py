"""Registry of the text operators' queries and their SQL."""

from __future__ import annotations

from . import decontaminate, fingerprints, html_text, jaccard_join, language_id, licenses, mixing, packing, phrases, sequenced, substring_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_language_id": language_id.op2_language_id,
        "op3_ngram_jaccard_join": jaccard_join.op3_ngram_jaccard_join,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op7_mixing": mixing.op7_mixing,
        "op8_licenses": licenses.op8_licenses,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_html_text": html_text.op10_html_text,
        "op11_changes": sequenced.op11_changes,
        "op12_phrases": phrases.op12_phrases,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; tests hold the others to brute-force versions."""
    return {"op1_warc": WARC_SQL, "op3_ngram_jaccard_join": JACCARD_SQL, "op4_substring_dedup": SUBSTRING_SQL, "op6_decontamination": DECONTAMINATION_SQL, "op12_phrases": PHRASES_SQL}


#: Digests to base32 in groups of 20 bits.
WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT *, list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(g * 5 + 1 AS INTEGER), 5) AS INTEGER) >> s) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest,
    max(page_id) OVER (PARTITION BY hex) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""

#: All pairs that share a shingle, then the links' transitive closure.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i + 1 : i + 5], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 4, least(len(words), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.y FROM r JOIN e ON r.reached = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) m ON m.node = w.doc_id
"""

#: Windows of every size that items have, as strings.
DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iw AS (
  SELECT DISTINCT item, size, array_to_string(words[p + 1 : p + size], ' ') AS seq
  FROM (SELECT item, words, least(13, len(words)) AS size, unnest(range(0, len(words) - least(13, len(words)) + 1)) AS p FROM i WHERE len(words) > 0)),
dw AS (
  SELECT doc_id, size, p, array_to_string(words[p + 1 : p + size], ' ') AS seq
  FROM (SELECT doc_id, words, size, unnest(range(0, greatest(len(words) - size + 1, 0))) AS p FROM d, (SELECT DISTINCT size FROM iw))),
hit AS (SELECT dw.doc_id, dw.p, dw.size, iw.item FROM dw JOIN iw ON dw.size = iw.size AND dw.seq = iw.seq),
covered AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM (SELECT doc_id, p, unnest(range(0, size)) AS j FROM hit) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(h.n, 0) AS n_items, sha256(coalesce(h.items, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.words) AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN held h ON h.doc_id = d.doc_id
"""

#: Windows of 20 words by list slices; the earliest of equal ones stays.
SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i + 1 : i + 20], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 19, 0))) AS i FROM w)),
late AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM late, range(20) t(j)),
words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS p FROM w),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS text, count(*) AS n
  FROM words x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

#: All n-grams within pieces, counted as lists of words; whole divisions of 128-bit numbers.
PHRASES_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
g AS (SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (SELECT lang, w, s, unnest(generate_series(1, len(w) - s + 1)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) v(s) WHERE len(w) >= s)),
f AS (SELECT lang, s, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (
  SELECT x.lang, x.s, x.phrase, x.f AS a, k, l.f AS l, r.f AS r, t.n AS n, CAST((CAST(1000 AS HUGEINT) * x.f * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM f x, (VALUES (1), (2), (3), (4)) v(k), f l, f r, t
  WHERE x.s > k AND l.lang = x.lang AND l.phrase = array_to_string(x.w[1:k], ' ') AND r.lang = x.lang AND r.phrase = array_to_string(x.w[k + 1:], ' ') AND t.lang = x.lang),
b AS (SELECT * EXCLUDE (j) FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM c) WHERE j = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = b.lang AND y.s > b.s AND contains(' ' || y.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * y.f >= 100 * b.a)),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d)
SELECT * FROM o WHERE rank <= 2000
"""
