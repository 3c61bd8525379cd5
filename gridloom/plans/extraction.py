"""From readers' attempts at a table to the tables that the chain takes: the steps between reading a page and heading its tables.

Each attempt is one reader's grid of one table. A table's attempts meet in one shuffle; a document's tables meet
once more, as rows without grids, to be numbered and to carry captions on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.operators import layout as L
from gridloom.operators import quality as Q
from gridloom.operators import rows as R
from gridloom.operators import stitch as ST
from gridloom.operators import structure as S

TABLE = ("doc_id", "page", "table_id")


def repaired(attempts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Attempts without crushed ruled grids; crushed header rows are spread and, with the page's ``words``, headers read again by place."""
    t = M.only(attempts, lambda x: (x["strategy"] != "lattice") | ~R.is_crushed(x["rows"]))
    t = t.withColumn("_missing", R.header_missing(F.col("rows")))  # before a repair changes what it looks at
    if words is not None:
        t = L.repair_headers(t, words)
    t = t.withColumn("rows", R.spread_crushed_header(F.col("rows")))
    if words is not None:
        t = L.recover_headers(t, words, missing=F.col("_missing"))
    return t.drop("_missing")


def best(attempts: DataFrame) -> DataFrame:
    """Each table once, by its best attempt: ``..., strategy, best_score, strategies_tried, low_quality, review_needed``."""
    t = attempts.withColumn("_s", Q.score(F.col("rows"))["score"])
    tried = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "strategy", "_s"))), lambda a: F.concat(a["strategy"], F.lit(":"), a["_s"].cast("string"))), "; ")
    rest = [c for c in attempts.columns if c not in (*TABLE, "attempt")]
    top = F.max_by(F.struct(*rest, "_s"), F.struct("_s", (-F.col("attempt")).alias("order")))
    t = t.groupBy(*TABLE).agg(top.alias("b"), tried.alias("strategies_tried")).select(*TABLE, "b.*", "strategies_tried")
    t = t.withColumn("_f", Q.kept_flags(F.col("_s")))
    return t.select(*TABLE, *rest, F.col("_s").alias("best_score"), "strategies_tried", F.col("_f.low_quality").alias("low_quality"), F.col("_f.review_needed").alias("review_needed"))


def parts(tables: DataFrame) -> DataFrame:
    """Panels side by side and stacked tables by themselves, numbered anew from 1 in reading order; a stacked part's title is its caption."""
    t = S.split_side_by_side(tables).withColumnRenamed("part", "_panel")
    t = S.split_stacked(t).withColumnRenamed("part", "_stack")
    t = t.withColumn("caption", F.coalesce("title", "caption")).drop("title")
    place = Window.partitionBy("doc_id").orderBy("page", "table_id", "_panel", "_stack")
    numbers = t.select(*TABLE, "_panel", "_stack", "caption").withColumn("_n", F.row_number().over(place).cast("long"))
    carried = ST.carry_captions(numbers.withColumn("_old", F.col("table_id")).withColumn("table_id", F.col("_n")))
    carried = carried.select("doc_id", "page", F.col("_old").alias("table_id"), "_panel", "_stack", "_n", F.col("caption").alias("_caption"))
    joined = t.join(carried, [*TABLE, "_panel", "_stack"])
    return joined.withColumn("source_table", F.col("table_id")).withColumn("table_id", F.col("_n")).withColumn("caption", F.col("_caption")).drop("_panel", "_stack", "_n", "_caption")


def extracted(attempts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """``doc_id, page, table_id, strategy, attempt, caption, rows`` to tables for ``plans.pipeline``.

    With ``words`` (``doc_id, page, x0, x1, top, text``) the attempts also hold ``top, row_tops, columns``.
    """
    t = best(repaired(attempts, words))
    return parts(t.drop("top", "row_tops", "columns"))
