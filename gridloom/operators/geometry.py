"""Words with coordinates to grids: repaired tokens, right-edge anchors, lines, bucketing.

A page's words are bounded, so they are packed per page and walked with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import model as M

# Value tokens, and tolerances in points.
VALUE_TOKEN = r"^\(?-?[\p{Nd},]{3,}(\.\p{Nd}+)?\)?$|^\(?-?\p{Nd}{1,3}\.\p{Nd}+\)?$|^\(?-?0\)?$"
LEAD = r"^\(?-?\p{Nd}{1,3}$"
LINE, EDGE, SNAP, GAP, CLUSTER = 3.0, 12.0, 6.0, 6.0, 3
PAGE = ("doc_id", "page")
TOKEN = "struct<x0:double,x1:double,top:double,text:string>"


def token(x0: Column, x1: Column, top: Column, text: Column) -> Column:
    return F.struct(x0.alias("x0"), x1.alias("x1"), top.alias("top"), text.alias("text"))


def split_fused(words: DataFrame) -> DataFrame:
    """Values printed together, "(1)(2)", become tokens with their share of the width."""
    parts = F.split("text", r"(?<=\))(?=\()")
    fused = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(VALUE_TOKEN))
    per = (F.col("x1") - F.col("x0")) / F.length("text")
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p))
    made = F.transform(parts, lambda p, i: token(F.col("x0") + per * before(i), F.col("x0") + per * (before(i) + F.length(p)), F.col("top"), p))
    whole = F.array(token(F.col("x0"), F.col("x1"), F.col("top"), F.col("text")))
    return words.withColumn("_t", F.explode(F.when(fused, made).otherwise(whole))).select(*PAGE, "_t.x0", "_t.x1", "_t.top", "_t.text")


def packed_tokens(words: DataFrame) -> DataFrame:
    """``doc_id, page, toks``: tokens of a page from top to bottom, left to right."""
    ordered = F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "text")))
    return words.filter("trim(text) <> ''").groupBy(*PAGE).agg(F.transform(ordered, lambda t: token(t["x0"], t["x1"], t["top"], F.trim(t["text"]))).alias("toks"))


def merge_split(toks: Column) -> Column:
    """A short leading fragment joins the numeric neighbour it nearly touches."""

    def step(out: Column, t: Column) -> Column:
        p = F.get(out, F.size(out) - 1)
        fits = (F.abs(p["top"] - t["top"]) <= LINE) & (t["x0"] - p["x1"]).between(0, GAP) & ~p["text"].rlike(VALUE_TOKEN) & p["text"].rlike(LEAD) & F.concat(p["text"], t["text"]).rlike(VALUE_TOKEN)
        joined = token(p["x0"], t["x1"], p["top"], F.concat(p["text"], t["text"]))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(t)))

    return F.aggregate(toks, F.array().cast(f"array<{TOKEN}>"), step)


def lines(toks: Column) -> Column:
    """Tokens by text line: a token belongs to the line whose first token is at most 3 points away."""
    line = f"struct<top:double,toks:array<{TOKEN}>>"

    def step(out: Column, t: Column) -> Column:
        p = F.get(out, F.size(out) - 1)
        own = F.struct(p["top"].alias("top"), F.concat(p["toks"], F.array(t)).alias("toks"))
        new = F.struct(t["top"].alias("top"), F.array(t).alias("toks"))
        return F.when(F.coalesce(F.abs(p["top"] - t["top"]) <= LINE, F.lit(False)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(own))).otherwise(F.concat(out, F.array(new)))

    return F.aggregate(toks, F.array().cast(f"array<{line}>"), step)


def right_edges(words: DataFrame, tol: float = EDGE, least: int = CLUSTER) -> DataFrame:
    """``doc_id, page, anchor_idx, anchor, n``: mean right edge of each run of values whose edges follow within ``tol``."""
    w = Window.partitionBy(*PAGE).orderBy("x1")
    values = words.filter(F.col("text").rlike(VALUE_TOKEN)).withColumn("_new", F.coalesce((F.col("x1") - F.lag("x1").over(w) > tol).cast("int"), F.lit(1)))
    runs = values.withColumn("_run", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    kept = runs.groupBy(*PAGE, "_run").agg(F.avg("x1").alias("anchor"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return kept.select(*PAGE, (F.row_number().over(Window.partitionBy(*PAGE).orderBy("_run")) - 1).alias("anchor_idx"), "anchor", "n")


def grid_from_words(words: DataFrame) -> DataFrame:
    """Grid rows ``doc_id, page, row_idx, cells`` of pages with two anchors and three rows of values; other tokens join the label."""
    toks = packed_tokens(split_fused(words)).withColumn("toks", merge_split(F.col("toks")))
    tokens = toks.select(*PAGE, F.explode("toks").alias("t")).select(*PAGE, "t.x0", "t.x1", "t.top", "t.text")
    anchors = right_edges(tokens).groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("anchor_idx", "anchor"))), lambda a: a["anchor"]).alias("anchors")).filter(F.size("anchors") >= 2)
    t = toks.join(anchors, list(PAGE)).withColumn("_l", lines(F.col("toks")))

    def nearest(x: Column) -> Column:
        return F.array_min(F.transform("anchors", lambda a, i: F.struct(F.abs(a - x["x1"]).alias("d"), i.alias("i"))))

    def row(line: Column) -> Column:
        by_x = F.array_sort(F.transform(line["toks"], lambda k: F.struct(k["x0"], k["x1"], k["text"])))
        init = F.struct(F.array().cast("array<string>").alias("label"), F.transform("anchors", lambda a: F.lit("")).alias("vals"))

        def place(s: Column, k: Column) -> Column:
            at = nearest(k)
            ok = k["text"].rlike(VALUE_TOKEN) & (at["d"] <= SNAP) & (F.get(s["vals"], at["i"]) == "")
            return F.struct(F.when(ok, s["label"]).otherwise(F.concat(s["label"], F.array(k["text"]))).alias("label"), F.transform(s["vals"], lambda v, i: F.when(ok & (i == at["i"]), k["text"]).otherwise(v)).alias("vals"))

        return F.aggregate(by_x, init, place, lambda s: F.concat(F.array(F.array_join(s["label"], " ")), s["vals"]))

    t = t.withColumn("rows", F.transform("_l", row))
    t = t.filter(M.count(F.col("rows"), lambda r: F.exists(F.slice(r, 2, F.size(r) - 1), lambda v: v != "")) >= 3)
    return t.select(*PAGE, F.posexplode("rows").alias("row_idx", "cells"))


def crop(words: DataFrame, x0: float, top: float, x1: float, bottom: float, pad: float = 2.0) -> DataFrame:
    """Words inside a box."""
    return words.filter((F.col("x0") >= x0 - pad) & (F.col("x1") <= x1 + pad) & (F.col("top") >= top - pad) & (F.col("top") <= bottom + pad))


def bucket_words(words: DataFrame, columns: DataFrame, pad: float = 0.0) -> DataFrame:
    """Each word with the first column range that holds its middle (J3): ``columns(doc_id, page, col_idx, lo, hi)``.

    Ranges of a page are few, so they meet its words in an equi-join by page, not in a cross join.
    """
    ranges = columns.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("col_idx", "lo", "hi"))).alias("_r"))
    mid = (F.col("x0") + F.col("x1")) / 2
    inside = F.filter("_r", lambda r: (mid >= r["lo"] - pad) & (mid <= r["hi"] + pad))
    return words.join(ranges, list(PAGE), "left").withColumn("col_idx", F.get(inside, F.lit(0))["col_idx"]).drop("_r")


def best_overlap(boxes: DataFrame, candidates: DataFrame, least: float = 0.3) -> DataFrame:
    """For each box the best-scoring candidate on its page that overlaps it by 0.3 of the smaller height."""
    c = candidates.select(*PAGE, F.struct("score", "cand_id", "c_top", "c_bottom").alias("c"))
    own = c.groupBy(*PAGE).agg(F.collect_list("c").alias("_c"))
    shared = lambda x: F.least(F.col("bottom"), x["c_bottom"]) - F.greatest(F.col("top"), x["c_top"])
    smaller = lambda x: F.least(F.col("bottom") - F.col("top"), x["c_bottom"] - x["c_top"])
    fits = F.filter("_c", lambda x: (shared(x) > 0) & (shared(x) >= least * smaller(x)))
    best = F.array_max(F.transform(fits, lambda x: F.struct(x["score"].alias("score"), (-x["cand_id"]).alias("order"))))
    return boxes.join(own, list(PAGE), "left").withColumn("_b", best).withColumn("cand_id", -F.col("_b.order")).withColumn("score", F.col("_b.score")).drop("_c", "_b")


def recover_cells(words: DataFrame, columns: DataFrame, rows: DataFrame, confidence: float = 40.0, pad: float = 3.0) -> DataFrame:
    """Recognised words into the cells whose row and column ranges hold their middles (S9); blank rows go."""
    sure = bucket_words(words.filter(F.col("conf") >= confidence), columns, pad)
    ranges = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("row_idx", "lo", "hi"))).alias("_r"))
    inside = F.filter("_r", lambda r: (F.col("mid_y") >= r["lo"] - pad) & (F.col("mid_y") <= r["hi"] + pad))
    placed = sure.join(ranges, list(PAGE)).withColumn("row_idx", F.get(inside, F.lit(0))["row_idx"]).filter("row_idx is not null and col_idx is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mid_y", "x0", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(*PAGE, "row_idx", "col_idx").agg(text.alias("v"))
