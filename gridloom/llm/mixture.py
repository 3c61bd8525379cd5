r"""Mixing sources to target weights by Pareto order sampling.

Targets. A source's size is the sum of its documents' words. Weights share ``factor`` of all words;
a target stops at ``cap`` times its source's size, and the excess is reshared by weight: target =
least(cap * size, c * weight), with the one c that makes the targets add up (found over the sorted caps).

Sample. floor(target / size) whole copies of each document are certain. Of the words still open in a source,
a document of s words is included once more with probability min(1, k * w(s)), w(s) = floor(100 * sqrt(s)):
longer documents likelier, with the one k that makes the expected words the open ones. Those with
probability 1 are certain too. The others are ranked by q = (u / (1 - u)) / (p / (1 - p)), u a uniform hash
of seed, id and text, and taken in that order while that brings the source nearer to its target.

Nothing gathers a source. Probabilities follow from the counts of documents by source and size; ranks
are first summed up in buckets, and only the bucket in which the open words run out is ordered, which gives
each source one last rank. A row then decides by itself, with the few numbers of its source at hand; the
rows and their texts are never shuffled.

Edge cases: null text has size 0, null source is a source of its own, placed last; sources of size 0 have
target 0; documents of size 0 take 0 words; ids may be null or shared; rows that are equal in id and text are
taken alike; an empty table gives an empty result; all columns of the input come back in ``row``, whatever
their names. Reruns give the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Cuts, running

WORDS = r"[^\x20\x09-\x0D]+"
BUCKETS = 1 << 14
BROADCAST_SOURCES = 300_000  # some 100 bytes each; more sources are joined by shuffle, rows salted
SALTS = 16


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(cuts: Cuts, totals: DataFrame, weights: tuple[float, ...], factor: float, cap: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row for each source."""
    w = F.array(*map(F.lit, map(float, weights)))
    placed = running(cuts, totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weighed = placed.withColumn("weight", F.element_at(w, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("full", cap * F.col("source_size") / F.col("weight"))
    ranked = running(cuts, weighed, [F.col("full").asc(), F.col("place").asc()], {"capped": cap * F.col("source_size"), "lighter": F.col("weight")})
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, weight = whole["size"] or 0, whole["weight"] or 0.0
    levels = ranked.withColumn("c", (F.lit(factor * total) - F.col("capped")) / (F.lit(weight) - F.col("lighter")))
    found = levels.filter("c <= full").agg(F.min(F.struct("full", "place", "c"))["c"].alias("c")).first()
    level = found["c"] if found and found["c"] is not None else 0.0
    return ranked.select("source", "source_size", F.least(cap * F.col("source_size"), level * F.col("weight")).alias("target"))


def _inclusion(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """The plan with ``k``, ``top`` and ``rest``: documents of up to ``top`` words share ``rest`` words by odds of k * w."""
    larger = Window.partitionBy("source").orderBy(F.col("size").desc())
    counts = (
        sizes.withColumnRenamed("source", "s").join(plan.filter("open > 0"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
        .withColumn("above", F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("mass", F.sum(F.col("n") * F.col("size") * F.col("w")).over(larger.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("k", (F.col("open") - F.col("above")) / F.col("mass"))
        .filter(F.col("k") * F.col("w") <= 1)
    )
    best = counts.groupBy("source").agg(F.max(F.struct("size", "k", "above")).alias("b")).select(F.col("source").alias("s"), "b.*")
    joined = plan.join(best, F.col("s").eqNullSafe(F.col("source")), "left")
    return joined.select(*plan.columns, "k", F.col("size").alias("top"), (F.col("open") - F.col("above")).alias("rest"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their source's plan get the rank ``q`` and its ``bucket``; null where nothing is drawn."""
    p = F.col("k") * F.col("w")
    drawn = (F.col("size") > 0) & (F.col("size") <= F.col("top"))
    q = F.when(drawn, F.col("u") / (1 - F.col("u")) * (1 - p) / p)
    return rows.withColumn("q", q).withColumn("bucket", F.floor(BUCKETS * F.col("q") / (1 + F.col("q"))))


def _last_ranks(cuts: Cuts, ranked: DataFrame) -> DataFrame:
    """``source, edge, last_q, last_key``: the bucket in which a source's open words run out, and the last rank taken there."""
    drawn = ranked.filter("q IS NOT NULL")
    sums = drawn.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("before", before).filter("before <= rest AND rest < before + words").select(F.col("source").alias("s"), F.col("bucket").alias("edge"), "before")
    edges = cuts.write(edges)
    inside = drawn.join(edges, F.col("s").eqNullSafe(F.col("source")) & (F.col("bucket") == F.col("edge"))).groupBy("source", "rest", "before", "q", "key").agg(F.sum("size").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("q", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = inside.withColumn("ahead", F.col("before") + ahead).filter(F.col("ahead") + F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("q", "key")).alias("last"))
    return edges.join(last, F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), "edge", F.col("last.q").alias("last_q"), F.col("last.key").alias("last_key"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), factor: float = 1.5, cap: float = 2.0, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row`` (the input's columns), ``size, source_size, target, copies, taken`` per row."""
    cuts = Cuts(docs.sparkSession)
    text_key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_key).cast("binary"))
    own = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("of"), word_count(text_col).alias("size"), key.alias("key"))
    own = own.withColumn("u", (F.conv(F.substring("key", 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)).withColumn("w", F.floor(100 * F.sqrt("size")))
    sized = cuts.write(own.drop("row"))
    totals = sized.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = source_targets(cuts, totals, weights, factor, cap)
    m = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("certain", F.floor(m)).withColumn("open", F.col("target") - F.col("certain") * F.col("source_size"))
    sizes = sized.filter("size > 0").groupBy(F.col("of").alias("source"), "size", "w").agg(F.count("*").alias("n"))
    plan = cuts.write(_inclusion(plan, sizes))
    sources = plan.count()
    last = _last_ranks(cuts, _ranked(_with_plan(sized, plan, sources)))
    plan = cuts.write(plan.join(last.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "left").drop("s"))
    ahead = (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & ((F.col("q") < F.col("last_q")) | ((F.col("q") == F.col("last_q")) & (F.col("key") <= F.col("last_key")))))
    once_more = F.when(F.col("size") > F.col("top"), True).when(F.col("q").isNotNull(), F.col("edge").isNull() | F.coalesce(ahead, F.lit(False))).otherwise(False)
    made = _ranked(_with_plan(own, plan, sources)).withColumn("copies", F.col("certain") + once_more.cast("long"))
    return made.select("row", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _with_plan(rows: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """Each row with the plan of its source ``of``."""
    same = F.col("of").eqNullSafe(F.col("source"))
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), same)
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("own_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("own_salt") == F.col("salt")))
