"""Catalogs, quarantine, promotions, jobs, learned maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import cells as C
from gridloom.functions import text as X


def catalog(tables: DataFrame) -> DataFrame:
    """One row per kept table with its counts and its names joined by bars."""
    return tables.select("doc_id", "table_id", F.col("name").alias("table_name"), F.get("pages", F.lit(0)).alias("page"), F.size("rows").alias("rows"), F.size("names").alias("columns"), F.array_join("names", "|").alias("column_names"))


def fallback_names(tables: DataFrame) -> DataFrame:
    """Unnamed tables are "Table n (p.p)", counted per document; several pages show as a range."""
    w = Window.partitionBy("doc_id").orderBy(F.get("pages", F.lit(0)), "table_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col("name").isNull().cast("int")).over(w)
    first, last = F.get("pages", F.lit(0)), F.element_at("pages", -1)
    named = F.coalesce("name", F.format_string("Table %d (p.%d)", n, first))
    ranged = F.when((F.size("pages") > 1) & F.col("name").isNotNull(), F.concat(named, F.format_string(" (pp. %d–%d)", first, last))).otherwise(named)
    return tables.withColumn("name", ranged)


def sheet_base(table_id: Column, name: Column) -> Column:
    """T, the table's code, and the first three telling words, without signs a sheet must not have."""
    code = F.coalesce(F.nullif(F.regexp_extract(name, r"(?i)(?:table|annexure|statement)\s*(\p{Nd}+(?:[.]\p{Nd}+)*)", 1), F.lit("")), table_id.cast("string"))
    words = F.slice(F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) > 2) & ~w.isin("table", "annexure", "statement", "the", "and", "for") & ~w.rlike(r"^\p{Nd}+$")), 1, 3)
    return F.substring(F.regexp_replace(F.concat_ws("_", F.concat(F.lit("T"), code), F.nullif(F.array_join(words, "_"), F.lit(""))), r"[\[\]:*?/\\]", "_"), 1, 28)


def sheet_names(tables: DataFrame) -> DataFrame:
    """``sheet``: unique per document; repeats get _2, _3 and so on in order."""
    t = tables.withColumn("_b", sheet_base(F.col("table_id"), F.coalesce("name", F.lit(""))))
    k = F.row_number().over(Window.partitionBy("doc_id", "_b").orderBy("table_id"))
    return t.withColumn("sheet", F.when(k > 1, F.concat("_b", F.lit("_"), k.cast("string"))).otherwise(F.col("_b"))).drop("_b")


def written_number(v: Column) -> Column:
    """What a sheet stores for a cell: whole and decimal texts as numbers."""
    return F.struct(F.when(v.rlike(r"^-?\p{Nd}+$"), "int").when(v.rlike(r"^-?\p{Nd}*\.\p{Nd}+$"), "float").otherwise("text").alias("kind"), F.when(v.rlike(r"^-?\p{Nd}+$|^-?\p{Nd}*\.\p{Nd}+$"), C.ascii_digits(v).try_cast("double")).alias("num"))


def search(catalog_: DataFrame, query: str) -> DataFrame:
    """Plain text inside a name (any case) or inside the id."""
    return catalog_.filter(F.lower("table_name").contains(query.lower()) | F.col("table_id").cast("string").contains(query))


def result_stats(found: DataFrame) -> DataFrame:
    """Tables found, kept and set aside, and the last page, over all documents."""
    return found.agg(F.count("*").alias("found"), F.count_if(F.col("reason") == "ok").alias("extracted"), F.count_if(F.col("reason") != "ok").alias("set_aside"), F.max("page").alias("max_page"))


def upsert_promoted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of both; of equal keys the one with the largest ``seq``, later ones after earlier ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc("seq")))
    return both.withColumn("_r", rank).filter("_r = 1").drop("_r", "_new")


def due_for_recheck(quarantine: DataFrame, run_id: str) -> DataFrame:
    """Quarantined rows that this run hasn't looked at."""
    return quarantine.filter(~F.col("last_rechecked").eqNullSafe(F.lit(run_id)))


def recheck(quarantine: DataFrame, again: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Promoted rows and the new quarantine after a fresh validation ``again(table, page, reason, score)``."""
    due = due_for_recheck(quarantine, run_id)
    fresh = again.select("table", "page", F.col("reason").alias("_now"), F.col("score").alias("_score"))
    seen = due.join(fresh, ["table", "page"], "left")
    promoted = seen.filter("_now = 'ok'").select("table", "page", F.lit(None).cast("string").alias("name"), "reason", F.col("_score").alias("score"), "strategies_tried", F.lit(run_id).alias("run_id"))
    kept = seen.filter("_now is null or _now <> 'ok'").select("table", "page", F.coalesce("_now", "reason").alias("reason"), F.coalesce("_score", "best_score").alias("best_score"), "strategies_tried", F.lit(run_id).alias("last_rechecked"))
    done = quarantine.filter(F.col("last_rechecked").eqNullSafe(F.lit(run_id)))
    return promoted, done.unionByName(kept)


def learn_map(pairs: DataFrame, least: int = 2) -> DataFrame:
    """For each legacy key its most frequent English label (the first seen of equals) with at least ``least`` sightings: ``pairs(key, label, ord)``."""
    sound = F.col("label").rlike("^[A-Z][A-Za-z]+([ .][A-Za-z]+)*$") & (F.length("label") >= 4) & (F.col("label") != F.col("key"))
    counted = pairs.filter(sound).groupBy("key", "label").agg(F.count("*").alias("n"), F.min("ord").alias("first_seen"))
    best = F.max_by(F.struct("label", "n"), F.struct("n", (-F.col("first_seen")).alias("f")))
    return counted.groupBy("key").agg(best.alias("b")).select("key", F.col("b.label").alias("label"), F.col("b.n").alias("n")).filter(F.col("n") >= least)


def job_status(validated: DataFrame) -> DataFrame:
    """Progress per document: invalid_source, queued, processing or done."""
    n = validated.groupBy("doc_id").agg(F.count("*").alias("total"), F.count("reason").alias("progress"), F.max("source_status").alias("source"))
    status = F.when(F.col("source").startswith("invalid_source"), "invalid_source").when(F.col("progress") == 0, "queued").when(F.col("progress") < F.col("total"), "processing").otherwise("done")
    return n.select("doc_id", "total", "progress", status.alias("status"))


def translated_cells(cells: DataFrame, use, column: str = "v") -> DataFrame:
    """Each distinct value is translated once and joined back (null stays null)."""
    said = cells.select(column).distinct().withColumn("_said", use(F.col(column)))
    return cells.join(said, column, "left").withColumn(column, F.col("_said")).drop("_said")


def looked_up(labels: DataFrame, lexicon: DataFrame, column: str = "label") -> DataFrame:
    """``value`` of each label: an exact key first, else one that differs in case and white space only. ``lexicon(key, value, ord)``: the first of equal loose keys counts."""
    loose = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    exact = lexicon.groupBy(F.col("key").alias(column)).agg(F.min_by("value", "ord").alias("_exact"))
    other = lexicon.groupBy(loose(F.col("key")).alias("_k")).agg(F.min_by("value", "ord").alias("_loose"))
    found = labels.join(exact, column, "left").withColumn("_k", loose(F.col(column))).join(other, "_k", "left")
    return found.withColumn("value", F.coalesce("_exact", "_loose")).drop("_exact", "_loose", "_k")


def stress_summary(found: DataFrame, stitched: DataFrame) -> DataFrame:
    """Per document: tables found, passed, after stitching, merges and orphan rows. ``found(doc_id, reason, orphan_rows)``, ``stitched(doc_id)``."""
    f = found.groupBy("doc_id").agg(F.count("*").alias("found"), F.count_if(F.col("reason") == "ok").alias("passed"), F.sum("orphan_rows").alias("orphans"))
    s = stitched.groupBy("doc_id").agg(F.count("*").alias("after_stitch"))
    return f.join(s, "doc_id", "left").select("doc_id", "found", "passed", F.coalesce("after_stitch", F.lit(0)).alias("after_stitch"), (F.col("passed") - F.coalesce("after_stitch", F.lit(0))).alias("merges"), "orphans")


def slugs(catalog_: DataFrame) -> DataFrame:
    return catalog_.withColumn("slug", X.slug(F.col("table_name")))
