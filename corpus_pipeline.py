"""A corpus pipeline over ``documents``: five stages, each of which takes effect on what the one before kept.

Extra columns are left out at once, whatever their names; an empty table gives an empty result; texts may be
of any length. What each stage does with nulls, ties and repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import _store, decontaminate, jaccard_join, language_id, mixing, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter, and those that are as far as can be from every language's profile
    (score 0: no n-gram of theirs is one of a profile's). The others keep their columns; a null lang becomes
    the predicted language. Profiles are learned from ``docs``; without a labelled document only texts
    without letters go. Each row is judged by its text alone, so ids may be null or repeated.
    """
    docs = _documents(docs)
    model = language_id.learn(docs)
    seen = language_id.predict(docs, model, COLUMNS)
    kept = seen.where((F.col("_lang") != language_id.UNKNOWN) & (F.col("_score") > 0)) if model.langs else docs.where(F.col("text").rlike(r"\p{L}")).withColumn("_lang", F.lit(None).cast("string"))
    return kept.withColumn("lang", F.coalesce("lang", "_lang")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that of the smallest doc_id (null is the smallest), then of the smallest text hash, then of the other columns.

    Rows without words link with nothing and all stay. Rows are told apart by (doc_id, text hash), so a text
    is never lost because another shares its id.
    """
    docs = _documents(docs)
    key = F.xxhash64("text")
    linked = jaccard_join.link_documents(docs, key=key).where("group is not null")
    ids = linked.groupBy("group", "doc_id", "key").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key", "n")
    # groups of one row need nothing; of the others the first key stays, with one row
    groups = ids.groupBy("group").agg(F.min(first).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    tops = groups.select("group", F.col("first.doc_id").alias("top"), F.col("first.key").alias("top_key"), F.col("first.n").alias("top_n"))
    stays = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("key") == F.col("top_key"))
    some = ids.join(tops, "group").where(~stays | (F.col("top_n") > 1)).select("doc_id", "key", stays.alias("stays"))
    some = _store.written(some, "copies")
    same = docs["doc_id"].eqNullSafe(some["doc_id"]) & (key == some["key"])
    out = docs.join(some, same, "left_anti")
    repeated = some.where("stays")
    if not repeated.isEmpty():
        held = docs.join(repeated, same, "left_semi").groupBy("doc_id", key.alias("_key")).agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("_row"))
        out = out.select(*COLUMNS).unionByName(held.select("doc_id", "_row.*").select(*COLUMNS))
    return out.select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; documents that lose every word go, texts that lose none stay as they are.

    Rows that repeat an id and its text are one document and lose the same; a null id is the smallest, and a null
    or wordless text stays.
    """
    out = substring_dedup.dedup_substrings(_documents(docs))
    out = out.where((F.col("_removed") == 0) | (F.col("_removed") < F.col("_words")))
    text = F.when(F.col("_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule of decontaminate.contamination() finds contaminated; null texts and any ids
    stay as they are, and an empty benchmark drops nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontaminate.contamination(decontaminate.mark(_documents(docs), items, COLUMNS))
    return marked.where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, and the shards that hold them.

    A null source is one of its own; wordless texts take nothing; repeated rows are texts of their own.
    """
    return mixing.by_document(mixing.mix_blocks(_documents(docs)))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The language stage has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _store.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
