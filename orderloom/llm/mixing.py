"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame functions. Targets are water-filled: the budget is shared by weight, no source goes
above ``repeat`` times its size, and what is above is shared again. Texts are cut into blocks of
``block`` words. A source is passed ``floor(target / size)`` times in full and once in part; in each
pass its blocks lie in a hashed permutation, and the pass takes them from its front until its quota of
words is met (the last block gives only the words that are missing).

The numbers of blocks that the passes take are exact quotas. A binary tree over the output shards
splits them: a node's left half gets a multivariate-hypergeometric draw of the node's quotas, the right
half the rest. The draw is divided among groups of ``FAN`` sources, theirs among their groups, and so on down
to the passes, each conditional on those before: no row holds more than ``FAN`` groups or the passes of ``FAN``
sources. A shard then takes disjoint stretches of each permutation, and ``slot`` shuffles it locally.

The permuted order of a source is never built in one task: hash buckets give offsets, and only blocks
of one bucket are ranked together. Sources are sorted by ranges and numbered by the ranges' counts; the
share a weight gets is found by rounds of one aggregate. Everything follows from hashes of the rows, so
reruns agree.

Defined results: null and wordless texts have size 0 and are never taken; sources of size 0 have
target 0; a null source is a source, the last; repeated rows are texts of their own; a null doc_id is
kept; an empty table gives an empty result. Texts of one doc_id and size are told apart by their hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _ranges, _store

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEAT = 2
BLOCK = 256
SHARD_LEVELS = 4
FAN = 64
#: Standard deviation up to which a draw inverts the distribution; beyond, it is a rejection sample. Both are exact.
INVERTED = 50
ATTEMPTS = 64
#: Rows of up to FAN parts that a task draws, at least, if there are more.
ROWS = 16
SEED = 20240917
#: White space of the word rule, and a run of it.
BLANKS = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """With ``rank``, by code point and null last: sorted in ranges, which are numbered by their counts."""
    ordered = sources.orderBy(F.col("source").isNull(), "source").withColumn("_at", F.monotonically_increasing_id())
    ordered = _store.written(ordered, "ranked")
    part = F.shiftrightunsigned("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a range
    before = [sum(n for q, n in counts if q < p) for p in range(counts[-1][0] + 1)] if counts else []
    rank = F.element_at(_ranges.numbers(before), (part + 1).cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1)
    return ordered.withColumn("rank", rank if counts else F.lit(0).cast("long")).drop("_at")


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeat: int = REPEAT) -> DataFrame:
    """(source, rank, source_size, blocks, target): one row a source."""
    s = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("blocks").alias("blocks")))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", repeat * F.col("source_size"))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:  # each round some more sources are full, or it is the last
        over = F.col("cap") <= share * F.col("weight")
        held, free, n = s.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if not free or n == full:
            break
        share, full = (budget * total - held) / free, n
    target = F.least(F.col("cap").cast("double"), share * F.col("weight"))
    return s.select("source", "rank", "source_size", "blocks", target.alias("target"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; keeps nested expressions from growing exponentially."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _log_factorial(x: Column) -> Column:
    """Stirling's series eight places further up, where three terms suffice."""

    def series(y: Column) -> Column:
        product = y
        for i in range(1, 8):
            product = product * (y - i)
        return y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + (1 - (1 - 2 / (7 * y * y)) / (30 * y * y)) / (12 * y) - F.log(product)

    return _let(x.cast("double") + 8, series)


def _uniform(*key: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *key), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(good: Column, total: Column, draws: Column, *key: Column) -> Column:
    """Successes among ``draws`` of ``total`` with ``good`` of them; the randomness is a hash of ``key``.

    Where the standard deviation is small, by inversion from one uniform number; beyond, by rejection
    (ratio of uniforms under the distribution's hat, cut at 16 deviations).
    """
    named = lambda **c: F.struct(*[x.alias(k) for k, x in c.items()])
    lf = _log_factorial
    bounds = lambda a: named(
        n=a["n"], k=a["k"], m=a["m"], low=F.greatest(F.lit(0.0), a["m"] - (a["n"] - a["k"])), high=F.least(a["k"], a["m"]), mean=a["m"] * a["k"] / F.greatest(a["n"], F.lit(1.0)),
        sd=F.sqrt(F.greatest(a["m"] * a["k"] * (a["n"] - a["k"]) * (a["n"] - a["m"]) / F.greatest(a["n"] * a["n"] * (a["n"] - 1), F.lit(1.0)), F.lit(0.0))),
    )
    weight = lambda a, x: lf(x) + lf(a["k"] - x) + lf(a["m"] - x) + lf(a["n"] - a["k"] - a["m"] + x)

    def inverted(a: Column) -> Column:
        n, k, m = a["n"], a["k"], a["m"]
        first = F.greatest(a["low"], F.floor(a["mean"] - 9 * a["sd"] - 9).cast("double"))
        last = F.least(a["high"], F.ceil(a["mean"] + 9 * a["sd"] + 9).cast("double"))

        def walked(e: Column) -> Column:
            density = F.exp(lf(k) + lf(n - k) - lf(n) + lf(m) + lf(n - m) - weight(a, e["first"]))

            def step(b: Column, i: Column) -> Column:
                following = b["p"] * (k - i) * (m - i) / ((i + 1) * F.greatest(n - k - m + i + 1, F.lit(1.0)))
                return named(p=following, sum=b["sum"] + b["p"], x=F.when((b["x"] < 0) & (b["sum"] + b["p"] >= e["u"]), i.cast("double")).otherwise(b["x"]))

            places = F.sequence(e["first"].cast("long"), F.greatest(e["first"], e["last"]).cast("long"))
            found = F.aggregate(places, named(p=density, sum=F.lit(0.0), x=F.lit(-1.0)), step, lambda b: b["x"])
            return _let(found, lambda x: F.when(x < 0, e["last"]).otherwise(x))

        return _let(named(first=first, last=last, u=_uniform(*key, F.lit(0))), walked)

    def rejected(a: Column) -> Column:
        mode = F.floor((a["m"] + 1) * (a["k"] + 1) / (a["n"] + 2)).cast("double")
        # constants of the ratio of uniforms: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)
        wide, more = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)

        def drawn(e: Column) -> Column:
            def attempt(x: Column, i: Column) -> Column:
                def judged(t: Column) -> Column:
                    inside = (t["x"] >= a["low"]) & (t["x"] <= a["high"]) & (F.abs(t["x"] - a["mean"]) <= 16 * a["sd"] + 1)
                    return F.when(inside, F.when(2 * F.log(t["u"]) <= e["top"] - weight(a, t["x"]), t["x"]).otherwise(-1.0)).otherwise(-1.0)

                u, v = _uniform(*key, i, F.lit(1)), _uniform(*key, i, F.lit(2))
                tried = lambda t: named(u=t["u"], x=F.floor(a["mean"] + 0.5 + e["hat"] * (t["v"] - 0.5) / t["u"]).cast("double"))
                return F.when(x >= 0, x).otherwise(_let(_let(named(u=u, v=v), tried), judged))

            found = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(-1.0), attempt)
            return _let(found, lambda x: F.when(x < 0, e["mode"]).otherwise(x))

        return _let(named(mode=mode, top=weight(a, mode), hat=wide * F.sqrt(a["sd"] * a["sd"] + 0.5) + more), drawn)

    either = lambda a: F.when(a["sd"] > INVERTED, rejected(a)).otherwise(inverted(a)).cast("long")
    return _let(_let(named(n=total.cast("double"), k=good.cast("double"), m=draws.cast("double")), bounds), either)


def _shares(parts: Column, draws: Column, *key: Column) -> Column:
    """How many of ``draws`` fall to each of ``parts`` (key, q): a multivariate-hypergeometric draw, part after part."""
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x["q"])

    def draw(a: Column, part: Column) -> Column:
        # the last part's population is all that is left, so its draw is certain
        got = hypergeometric(part["q"], a["pool"], a["draws"], *key, part["key"])
        return _let(got, lambda g: F.struct((a["pool"] - part["q"]).alias("pool"), (a["draws"] - g).alias("draws"), F.concat(a["left"], F.array(g)).alias("left")))

    start = F.struct(total.alias("pool"), draws.alias("draws"), F.array().cast("array<bigint>").alias("left"))
    return F.aggregate(parts, start, draw, lambda a: a["left"])


def _few(table: DataFrame) -> DataFrame:
    """In as many parts as its rows give tasks work: a draw's expression is large, and every task of its stage unpacks it, with rows or without."""
    return table.repartition(max(1, min(_store.tasks(table.sparkSession), -(-table.count() // ROWS))))


def split_quotas(quotas: DataFrame, levels: int = SHARD_LEVELS, fan: int = FAN) -> DataFrame:
    """(key, cuts): where along a key's taken blocks each of the 2^levels shards ends. quotas: (key, q); a source's keys are 64 apart."""
    bits = (fan - 1).bit_length()
    deepest = quotas.agg(F.max("key")).first()[0] or 0
    heights = max(1, -(-(deepest // 64).bit_length() // bits))
    summed = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x["q"])
    part = F.struct("key", "q")
    # one expression for all levels: putting it together takes the driver longer than a level's draws
    left = _shares(F.col("parts"), F.col("draws"), F.col("level"), F.col("height"), F.col("node"))
    leaves = quotas.groupBy(F.floor(F.col("key") / (64 << bits)).alias("g")).agg(F.sort_array(F.collect_list(part)).alias("parts")).withColumn("node", F.lit(0).cast("long"))
    leaves = _store.written(leaves, "tree")
    for level in range(levels):
        tiers = [leaves.select("node", "g", "parts")]
        for _ in range(heights - 1):
            up = tiers[-1].select("node", F.floor(F.col("g") / (1 << bits)).alias("up"), F.struct(F.col("g").alias("key"), summed("parts").alias("q")).alias("part"))
            tiers.append(up.groupBy("node", F.col("up").alias("g")).agg(F.sort_array(F.collect_list("part")).alias("parts")))
        drawn = tiers[-1].withColumn("draws", F.floor(summed("parts") / 2).cast("long"))
        drawn = _few(drawn if heights == 1 else _store.written(drawn, "tree"))
        for height, tier in reversed(list(enumerate(tiers))):
            if height < heights - 1:
                below = drawn.select("node", F.explode(F.arrays_zip("parts", "left")).alias("x")).select("node", F.col("x.parts.key").alias("g"), F.col("x.left").alias("draws"))
                drawn = _few(_store.written(tier.join(below, ["node", "g"]), "tree"))
            drawn = drawn.withColumns({"level": F.lit(level), "height": F.lit(height)}).withColumn("left", left)
        give = lambda q: F.zip_with("parts", "left", lambda p, x: F.struct(p["key"].alias("key"), q(p["q"], x).alias("q")))
        halves = F.array(F.struct((2 * F.col("node")).alias("node"), give(lambda q, x: x).alias("parts")), F.struct((2 * F.col("node") + 1).alias("node"), give(lambda q, x: q - x).alias("parts")))
        leaves = _store.written(drawn.select("g", F.explode(halves).alias("half")).select("g", "half.node", "half.parts"), "tree")
    each = leaves.select("node", F.explode("parts").alias("e")).select("node", "e.key", "e.q")
    upto = F.sum("q").over(W.partitionBy("key").orderBy("node"))
    return each.withColumn("to", upto).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "to"))), lambda x: x["to"]).alias("cuts"))


def mix_blocks(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeat: int = REPEAT, block: int = BLOCK, levels: int = SHARD_LEVELS) -> DataFrame:
    """A row for each block and pass of each text: what the mix takes of it, and its place.

    (_row, doc_id, size, source_size, target, pass, block, taken, shard, slot): ``taken`` words from the
    front of the block; a shard, ordered by ``slot``, is a shuffled part of the mix. Blocks that aren't
    taken have taken 0 and no shard.
    """
    size = word_count(F.col("text"))
    sized = docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), F.xxhash64("text").alias("th")).withColumn("blocks", F.ceil(F.col("size") / block).cast("long"))
    sized = _store.written(sized.withColumn("_row", F.monotonically_increasing_id()), "sized")
    sources = _store.written(source_targets(sized, weights, budget, repeat), "sources")
    total = sources.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(total / 1000, 2))))

    quota = F.floor(F.col("target") + 0.5).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.withColumn("full", F.least(full, F.lit(repeat))).withColumn("rest", quota - F.col("full") * F.col("source_size"))
    rows = sized.drop("blocks").join(plan.drop("blocks"), sized["source"].eqNullSafe(plan["source"])).drop("source")
    last = F.greatest(F.ceil(F.col("size") / block), F.lit(1)) - 1
    passes = F.sequence(F.lit(0).cast("long"), F.when((F.col("rest") > 0) | (F.col("full") == 0), F.col("full")).otherwise(F.col("full") - 1))
    rows = rows.withColumn("pass", F.explode(passes)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("words", F.greatest(F.least(F.col("size") - block * F.col("block"), F.lit(block)), F.lit(0)))
    rows = rows.withColumn("hash", F.xxhash64(F.lit(SEED), "pass", "doc_id", "size", "th", "block"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits)).withColumn("key", F.col("rank") * 64 + F.col("pass"))

    sums = rows.groupBy("key", "bucket").agg(F.sum("words").alias("w"), F.count_if(F.col("words") > 0).alias("n"))
    before = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("key", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = W.partitionBy("key", "bucket").orderBy("hash", "doc_id", "th", "_row", "block").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.join(offsets, ["key", "bucket"])
    ranked = ranked.withColumns({"at": F.col("w0") + F.coalesce(F.sum("words").over(inside), F.lit(0)), "nth": F.col("n0") + F.coalesce(F.count_if(F.col("words") > 0).over(inside), F.lit(0))})
    limit = F.when(F.col("pass") < F.col("full"), F.col("source_size")).otherwise(F.col("rest"))
    ranked = ranked.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), limit - F.col("at"))).cast("long"))
    ranked = _store.written(ranked.select("_row", "doc_id", "size", "th", "source_size", "target", "key", "pass", "block", "taken", "nth"), "blocks")
    _store.dropped(sized, sources)

    quotas = ranked.where("taken > 0").groupBy("key").agg(F.count("*").alias("q"))
    cuts = _store.written(split_quotas(quotas, levels), "cuts")
    out = ranked.join(cuts, "key", "left")
    shard = F.when(F.col("taken") > 0, F.size(F.filter("cuts", lambda c: c <= F.col("nth"))))
    slot = F.when(F.col("taken") > 0, F.xxhash64(F.lit(SEED + 1), "key", "doc_id", "size", "th", "block"))
    return out.select("_row", "doc_id", "size", "source_size", "target", "pass", "block", "taken", shard.alias("shard"), slot.alias("slot"))


def by_document(blocks: DataFrame) -> DataFrame:
    """A row for each text; ``shards`` are those that hold words of it."""
    out = blocks.groupBy("_row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_set("shard")).alias("s"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("s").cast("array<string>"), ",").alias("shards"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return by_document(mix_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet")))
