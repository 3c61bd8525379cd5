"""Scores, archetypes, corruption and metrics of packed tables, and their roll-ups over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C
from gridloom.functions import text as X
from gridloom.operators import rows as R

# Codes, measures and names without meaning.
STRUCTURED_CODE = r"^\p{Nd}{3,4}\.\p{Nd}{2,4}$"
RECORD_CODE = r"^\(?\p{Nd}{1,4}(\.\p{Nd}{1,4})?\)?$"
MEASURE = r"^\(?-?\p{Nd}{1,3}(,\p{Nd}{3})+(\.\p{Nd}+)?\)?%?$|^\(?-?\p{Nd}+\.\p{Nd}{1,2}\)?%?$|^-?\p{Nd}{1,2}(\.\p{Nd}+)?%$"
GENERIC = r"^(col|value|label)(_[0-9]+)?$"
NAMELESS = r"^col(_[0-9]+)?$"
SUBLABELS = ("rural", "urban", "total", "male", "female", "males", "females", "person", "persons")
LOW_QUALITY, REVIEW = 0.70, 0.50


def round3(x: Column) -> Column:
    return F.bround(x, 3)


def numeric_fraction(rows: Column) -> Column:
    return M.share(R.non_empty(M.flat(rows)), lambda v: v.rlike(C.NUMBER))


def score(rows: Column, names: Column | None = None) -> Column:
    """A struct of the extraction score and its parts; without names, columns filled by half stand for named ones."""
    cells = M.flat(rows)
    filled = R.non_empty(cells)
    content = F.filter(filled, lambda v: ~F.lower(v).isin(*C.SCORE_PLACEHOLDERS))

    def parts(s: Column) -> Column:
        c = s["content"]
        numeric, texty = M.share(c, C.is_value), M.share(c, lambda v: v.rlike("[A-Za-z]{2,}"))
        label = M.share(c, lambda v: ~C.is_value(v) & v.rlike("[A-Za-z]{2,}") & (C.word_count(v) <= 6))
        merged = M.share(c, lambda v: v.rlike(C.RUN_OF_NUMBERS))
        text = (numeric < 0.30) & (texty >= 0.60) & (s["fill"] >= 0.60)
        raw = round3(0.4 * F.when(text, texty).otherwise(numeric + label) + 0.4 * s["coherence"] + 0.2 * s["fill"])
        final = F.when(merged > 0.15, F.least(raw, F.lit(0.45))).when(merged > 0.05, round3(F.greatest(raw - 0.15, F.lit(0.0)))).otherwise(raw)
        return F.struct(
            F.when(s["n"] > 0, final).otherwise(0.0).alias("score"), round3(numeric).alias("numeric_density"), round3(s["coherence"]).alias("header_coherence"),
            round3(s["fill"]).alias("fill_rate"), round3(merged).alias("merged_frac"), text.alias("text_mode"),
        )

    if names is None:
        coherence = M.share(M.by_column(rows, lambda v, i: M.share(v, C.populated)), lambda f: f >= 0.5)
    else:
        coherence = M.share(names, lambda n: ~F.lower(n).rlike(GENERIC))
    base = F.struct(content.alias("content"), coherence.alias("coherence"), F.size(cells).alias("n"), F.when(F.size(cells) > 0, F.size(filled) / F.size(cells)).otherwise(0.0).alias("fill"))
    return M.bind(base, parts)


def kept_flags(score_: Column) -> Column:
    return F.struct((score_ < LOW_QUALITY).alias("low_quality"), (score_ < REVIEW).alias("review_needed"))


def best_attempts(attempts: DataFrame, *keys: str) -> DataFrame:
    """The best attempt (``strategy, attempt, score``) per table: only a strictly better score replaces an earlier one; all are listed in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("attempt", "strategy", "score"))), lambda a: F.struct(a["strategy"].alias("strategy"), a["score"].alias("score")))
    best = F.max_by(F.struct("strategy", "score"), F.struct("score", (-F.col("attempt")).alias("order")))
    return attempts.groupBy(*keys).agg(best.alias("best"), listed.alias("attempts")).select(*keys, F.col("best.strategy").alias("strategy"), F.col("best.score").alias("best_score"), "attempts")


def archetype(rows: Column) -> Column:
    """reference: codes on many rows, much text and hardly a measure; else statistical. The first row doesn't count."""
    body = F.when(F.size(rows) > 1, M.tail(rows, F.lit(1))).otherwise(rows)

    def judged(s: Column) -> Column:
        v = F.filter(F.transform(M.flat(s["body"]), C.strip), lambda x: ~F.lower(x).isin(*C.BLANK))
        code = M.share(s["body"], lambda r: F.exists(r, lambda x: C.strip(x).rlike(STRUCTURED_CODE)))
        text = M.share(v, lambda x: C.lettered_words(x) >= 2)
        measure = M.share(v, lambda x: x.rlike(MEASURE) & ~x.rlike(STRUCTURED_CODE))
        small = (F.size(v) < 4) | (F.size(s["body"]) < 3)
        reference = ~small & (code >= 0.4) & (text >= 0.25) & (measure < 0.15)
        zero = lambda x: F.when(small, 0.0).otherwise(round3(x))
        return F.struct(F.when(reference, "reference").otherwise("statistical").alias("archetype"), zero(code).alias("code_row_frac"), zero(text).alias("text_cell_frac"), zero(measure).alias("measure_cell_frac"))

    return M.bind(F.struct(body.alias("body")), judged)


def reference_header_rows(rows: Column) -> Column:
    """Rows above the first of the top eight that holds a code."""
    at = M.first_index(M.head(rows, 8), lambda r: F.exists(r, lambda v: C.strip(v).rlike(RECORD_CODE) & ~C.strip(v).isin("0", "(0)")))
    return F.coalesce(at, F.when(F.size(rows) > 1, 1).otherwise(0))


def corruption(rows: Column) -> Column:
    """Share of filled cells in Devanagari or legacy-font soup, and which of the two prevails."""

    def judged(kinds: Column) -> Column:
        deva, soup = M.count(kinds, lambda k: k == "deva"), M.count(kinds, lambda k: k == "kruti")
        n = F.size(kinds)
        return F.struct(F.when(n > 0, (deva + soup) / n).otherwise(0.0).alias("score"), F.when(deva + soup == 0, F.lit(None)).when(deva >= soup, "deva").otherwise("kruti").alias("dominant"))

    return M.bind(F.filter(F.transform(M.flat(rows), X.script_kind), lambda k: k.isNotNull()), judged)


def is_composite(name: Column) -> Column:
    """A header of three parts, or two with a sub-label or a year."""
    parts = F.filter(F.split(name, "_"), lambda p: p != "")
    return (F.size(parts) >= 3) | ((F.size(parts) >= 2) & F.exists(parts, lambda p: p.isin(*SUBLABELS) | p.rlike(r"^(19|20)\p{Nd}{2}$")))


def metrics(rows: Column, names: Column, title: Column) -> Column:
    """The per-table measurements that a corpus scorecard sums up."""
    typed = M.by_column(rows, lambda v, i: M.bind(R.non_empty(v), lambda own: F.struct(M.share(own, lambda x: x.rlike(C.NUMBER)).alias("like"), M.share(own, lambda x: C.to_number(x).isNotNull()).alias("typed"), F.size(own).alias("n"))))
    intended = F.filter(typed, lambda t: (t["like"] >= 0.5) & (t["n"] > 0))
    values = R.non_empty(M.flat(F.transform(rows, R.tail_cells)))
    nameless = M.count(names, lambda n: n.rlike(NAMELESS))
    return F.struct(
        F.size(rows).alias("rows"), F.size(names).alias("cols"), nameless.alias("col_n"), (nameless / F.greatest(F.size(names), F.lit(1))).alias("col_n_frac"),
        (F.size(names) - F.size(F.array_distinct(names))).alias("dup_cols"), F.array_contains(names, "category").alias("has_category"),
        M.count(names, is_composite).alias("composite_cols"), M.share(values, lambda v: v.rlike(C.NUMBER)).alias("numeric_value_frac"),
        F.when(F.size(intended) > 0, F.aggregate(intended, F.lit(0.0), lambda a, t: a + t["typed"]) / F.size(intended)).alias("numeric_readiness"),
        F.size(intended).alias("intended_numeric_cols"), M.count(typed, lambda t: t["typed"] >= 0.8).alias("numeric_cols"), M.count(names, lambda n: n.rlike("^value(_[0-9]+)?$")).alias("value_cols"),
        M.count(rows, R.is_orphan).alias("orphan_rows"), M.count(rows, lambda r: F.exists(r, lambda v: F.coalesce(v, F.lit("")).rlike("[ऀ-ॿ]"))).alias("deva_rows"),
        title.isNotNull().alias("named"), title.alias("title"),
    )


def scorecard(measured: DataFrame) -> DataFrame:
    """One row over all tables; ``measured`` holds the fields of ``metrics`` as columns."""
    return measured.agg(
        F.count("*").alias("total_tables"), F.avg("col_n_frac").alias("mean_col_n_frac"), F.avg((F.col("dup_cols") > 0).cast("double")).alias("dup_cols_frac"),
        F.avg(F.col("has_category").cast("double")).alias("category_frac"), F.avg((F.col("composite_cols") > 0).cast("double")).alias("composite_frac"),
        F.avg("numeric_value_frac").alias("mean_numeric_value_frac"), F.avg("numeric_readiness").alias("mean_numeric_readiness"),
        F.avg((F.col("orphan_rows") > 0).cast("double")).alias("orphan_table_frac"), F.avg((F.col("deva_rows") > 0).cast("double")).alias("deva_leak_frac"), F.avg(F.col("named").cast("double")).alias("named_frac"),
    )


def document_summary(validated: DataFrame) -> DataFrame:
    """Tables found and passed per document, and how often each reason occurred."""
    by_reason = validated.groupBy("doc_id", "reason").agg(F.count("*").alias("n"))
    failed = F.filter(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: x["reason"] != "ok")
    return by_reason.groupBy("doc_id").agg(F.sum("n").alias("found"), F.coalesce(F.sum(F.when(F.col("reason") == "ok", F.col("n"))), F.lit(0)).alias("passed"), failed.alias("failed_reasons"))


def csv_quality(columns: Column, unknown: Column, rows: Column) -> Column:
    """100, less 50 times the share of unknown columns and 30 for under five rows; good from 60."""
    s = 100 - 50 * unknown / columns - F.when(rows < 5, 30).otherwise(0)
    return F.struct(s.alias("score"), (s >= 60).alias("good"))
