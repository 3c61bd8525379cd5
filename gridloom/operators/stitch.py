"""Continuations across pages (J6, R9, H18-H20, W5, W6): decided on one metadata row per table, applied relationally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.operators import naming as N

FALLBACK = r"^(col(_[0-9]+)?|_ext_[0-9]+)$"
ITEMS = "doc_id long, table_id long, page int, name string, n_rows int, names array<string>"


def upgraded(base: Column, other: Column) -> Column:
    """Names of the base; where one is a fallback, a real name of the continuation."""
    return F.transform(base, lambda n, i: F.when(n.rlike(FALLBACK) & ~F.coalesce(F.get(other, i), F.lit("col")).rlike(FALLBACK), F.get(other, i)).otherwise(n))


def continues(base: Column, item: Column) -> Column:
    """Does an item go on from the open group ``base`` (name, last page, n_rows, names)?"""
    a, b = base["name"], item["name"]
    near = (item["page"] - base["last_page"] <= 2) & (F.abs(F.size(base["names"]) - F.size(item["names"])) <= 2)
    strong = N.is_strong_title(a) & N.is_strong_title(b) & (a != b)
    same_names = N.names_match(base["names"], item["names"], 0.8) & (N.named_fraction(base["names"]) >= 0.5) & (base["n_rows"] >= 6) & (item["n_rows"] >= 2)
    headless = ~N.is_strong_title(b) & (N.named_fraction(item["names"]) < 0.2) & a.isNotNull() & (base["n_rows"] >= 4) & (item["n_rows"] >= 2)
    return F.when(~near, False).when(F.coalesce(a == b, F.lit(False)), True).when(F.coalesce(strong, F.lit(False)) | N.are_entity_variants(a, b), False).otherwise(same_names | headless)


def groups(items: DataFrame) -> DataFrame:
    """``doc_id, groups``: per document its items in page order, folded into groups.

    The fold carries the open group's last page, row count, adopted title and upgraded names. Only
    metadata is gathered: one small row per table of one document.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page", "table_id", "name", "n_rows", "names")))
    group = "struct<name:string,last_page:int,n_rows:int,names:array<string>,pages:array<int>,members:array<struct<table_id:bigint,row_offset:int>>>"

    def start(x: Column) -> Column:
        return F.struct(x["name"].alias("name"), x["page"].alias("last_page"), x["n_rows"].alias("n_rows"), x["names"].alias("names"), F.array(x["page"]).alias("pages"), F.array(F.struct(x["table_id"].alias("table_id"), F.lit(0).alias("row_offset"))).alias("members"))

    def add(g: Column, x: Column) -> Column:
        names = F.when(F.size(g["names"]) == F.size(x["names"]), upgraded(g["names"], x["names"])).when(F.size(g["names"]) > F.size(x["names"]), g["names"]).otherwise(x["names"])
        member = F.struct(x["table_id"].alias("table_id"), g["n_rows"].alias("row_offset"))
        return F.struct(F.coalesce(g["name"], x["name"]).alias("name"), x["page"].alias("last_page"), (g["n_rows"] + x["n_rows"]).alias("n_rows"), names.alias("names"), F.concat(g["pages"], F.array(x["page"])).alias("pages"), F.concat(g["members"], F.array(member)).alias("members"))

    def step(state: Column, x: Column) -> Column:
        g = F.element_at(state, -1)
        grown = F.concat(F.slice(state, 1, F.size(state) - 1), F.array(add(g, x)))
        return F.when((F.size(state) > 0) & continues(F.get(state, F.size(state) - 1), x), grown).otherwise(F.concat(state, F.array(start(x))))

    packed = items.groupBy("doc_id").agg(ordered.alias("items"))
    return packed.select("doc_id", F.aggregate("items", F.array().cast(f"array<{group}>"), step).alias("groups"))


def stitched_items(items: DataFrame) -> DataFrame:
    """One row per group: ``doc_id, group_id, name, pages, n_rows, names, members``; untitled groups inherit."""
    flat = groups(items).select("doc_id", F.posexplode("groups").alias("group_id", "g")).select("doc_id", "group_id", "g.name", "g.pages", "g.n_rows", "g.names", "g.members")
    return inherit_titles(flat)


def inherit_titles(grouped: DataFrame) -> DataFrame:
    """An untitled group on the page after the last titled one, of equal width and similar (or no) names, is "title (cont.)"."""
    w = Window.partitionBy("doc_id").orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1)
    named = F.col("name").isNotNull() & ~F.coalesce(F.col("name").rlike(FALLBACK), F.lit(False))
    last = F.last(F.when(named, F.struct("name", "pages", "names")), ignorenulls=True).over(w)
    t = grouped.withColumn("_l", last)
    fits = (F.get("pages", F.lit(0)) - F.element_at("_l.pages", -1) == 1) & (F.size("names") == F.size("_l.names")) & (N.names_match(F.col("_l.names"), F.col("names"), 0.5) | (N.named_fraction(F.col("names")) < 0.2))
    adopted = F.concat(F.regexp_replace("_l.name", r"\s*\(cont\.\)$", ""), F.lit(" (cont.)"))
    return t.withColumn("name", F.when(F.col("name").isNull() & F.coalesce(fits, F.lit(False)), adopted).otherwise(F.col("name"))).drop("_l")


def stitch(tables: DataFrame, stitched: DataFrame, distinct: bool = True) -> DataFrame:
    """Rows of member tables, packed again per group: ``doc_id, table_id, name, pages, names, rows`` (equal rows once)."""
    member = stitched.select("doc_id", "group_id", "name", "pages", "names", F.explode("members").alias("m")).select("doc_id", "group_id", "name", "pages", "names", F.col("m.table_id").alias("table_id"), F.col("m.row_offset").alias("row_offset"))
    own = tables.select("doc_id", "table_id", "rows").join(member, ["doc_id", "table_id"])
    even = F.transform("rows", lambda r: F.transform(M.indices(F.size("names")), lambda i: F.coalesce(F.get(r, i), F.lit(""))))
    own = own.withColumn("_rows", even)
    rows = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_offset", "table_id", "_rows"))), lambda x: x["_rows"]))
    made = own.groupBy("doc_id", "group_id").agg(F.min("table_id").alias("table_id"), F.any_value("name").alias("name"), F.any_value("pages").alias("pages"), F.any_value("names").alias("names"), rows.alias("rows"))
    return made.withColumn("rows", F.array_distinct("rows") if distinct else F.col("rows"))


def carry_captions(items: DataFrame, pages: int = 5) -> DataFrame:
    """Blank captions take the last section heading of the document, at most five pages back."""
    w = Window.partitionBy("doc_id").orderBy("page", "table_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.trim("caption").rlike(r"(?i)^(chapter|section|part|annex(ure)?)\b") | F.trim("caption").rlike(r"^\p{Nd}{1,2}(\.\p{Nd}{1,2})+[\s\-–:]+[A-Z]")
    last = F.last(F.when(heading, F.struct("caption", "page")), ignorenulls=True).over(w)
    t = items.withColumn("_l", last)
    blank = F.coalesce(F.trim("caption"), F.lit("")) == ""
    return t.withColumn("caption", F.when(blank & (F.col("page") - F.col("_l.page") <= pages), F.col("_l.caption")).otherwise(F.col("caption"))).drop("_l")
