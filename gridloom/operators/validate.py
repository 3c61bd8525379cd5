"""Validation of packed tables: the first reason of the list that holds, else ok."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C
from gridloom.operators import quality as Q
from gridloom.operators import rows as R

# The vocabulary of front matter, contents lists and page footers.
PAGE_NUMBER = r"^\p{Nd}{1,3}$"
FOOTER = r"(?i)\p{Nd}+\s*\|\s*P\s+a\s+g\s+e"
HONORIFIC = r"(?i)\b(Shri|Smt|Dr|Prof|Sh\.|Km\.|Shrimati|Ku\.)\b"
JOB = r"(?i)\b(Director|Officer|Assistant|Deputy|Joint|Additional|Analyst|Statistician|Superintendent|Inspector|Registrar|Commissioner|Secretary|Manager|Advisor|Consultant|Head)\b"
FIELD = r"(?i)(rank|score|rate|percent|ratio|count|amount|value|total|number|year|period|status|level|index)"
INDEX_WORD = r"\b(index|contents)\b|विषय\s*सूची"
TABLE_REF = r"(?i)\b(table\s*no|chapters?|sl\.?\s*no|s\.?\s*no|annexure\s*no)\b"
PAGE_REF = r"(?i)\bpage\s*no\b|\bpage\b"
PAGE_OR_RANGE = r"^\p{Nd}{1,4}[-–]\p{Nd}{1,4}$|^\p{Nd}{1,3}$"
SECTION = r"^\p{Nd}{1,3}[A-Za-z]?(\.\p{Nd}{1,3})*$"
SENTENCE = r"[A-Za-z]{2,}(?:[\s,]+[A-Za-z]{2,}){5,}"


def mean_length(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + F.length(v)) / F.size(values)).otherwise(0.0)


def _inner(rows: Column) -> Column:
    return F.filter(M.indices(M.width(rows) - 1), lambda i: i > 0)


def is_front_matter(rows: Column, names: Column) -> Column:
    """Page numbers in a last column beside long text, or honorifics with job titles."""
    last = F.transform(rows, lambda r: C.strip(F.element_at(r, -1)))
    name = F.lower(F.element_at(names, -1))
    paged = (M.share(last, lambda v: v.rlike(PAGE_NUMBER)) >= 0.55) & (name.rlike("^col_?[0-9]*$") | name.contains("page") | ~name.rlike(FIELD))
    long = F.exists(M.indices(M.width(rows) - 1), lambda i: mean_length(F.transform(M.column(rows, i), C.strip)) > 15)
    text = F.array_join(M.flat(rows), " ")
    return (F.size(rows) >= 3) & ((paged & long) | (text.rlike(HONORIFIC) & text.rlike(JOB)))


def is_contents(rows: Column, names: Column) -> Column:
    """Dotted leaders, the vocabulary of a contents list, or section numbers, titles and pages."""
    filled = R.non_empty(M.flat(rows))
    leaders = M.share(filled, lambda v: v.rlike(r"\.{4,}")) >= 0.25
    head = F.concat_ws(" ", F.array_join(M.flat(M.head(rows, 2)), " "), F.array_join(names, " "))
    last = R.non_empty(F.transform(rows, lambda r: F.element_at(r, -1)))
    first = R.non_empty(M.column(rows, F.lit(0)))
    words = (head.rlike(INDEX_WORD) & (head.rlike(PAGE_REF) | head.rlike(TABLE_REF))) | (head.rlike(TABLE_REF) & head.rlike(PAGE_REF) & (M.share(last, lambda v: v.rlike(PAGE_NUMBER)) >= 0.5))
    inner = F.filter(F.transform(_inner(rows), lambda i: R.non_empty(M.column(rows, i))), lambda v: F.size(v) > 0)
    shape = (
        (M.width(rows) >= 3) & (F.size(last) > 0) & (M.share(first, lambda v: v.rlike(SECTION)) >= 0.5)
        & (M.share(last, lambda v: F.regexp_replace(v, " ", "").rlike(PAGE_OR_RANGE)) >= 0.5)
        & F.exists(inner, lambda v: mean_length(v) > 20) & ~F.exists(inner, lambda v: M.share(v, lambda x: x.rlike(C.NUMBER)) >= 0.5)
    )
    return (F.size(rows) >= 2) & (F.size(filled) > 0) & (leaders | words | shape)


def is_prose(rows: Column) -> Column:
    v = R.non_empty(M.flat(rows))
    numbers = M.count(v, lambda x: x.rlike(C.NUMBER))
    sentences = M.share(v, lambda x: (C.word_count(x) >= 6) & x.rlike(SENTENCE))
    return (F.size(v) >= 3) & (sentences >= 0.4) & ((numbers < 0.1 * F.size(v)) | (numbers <= 1))


def reason(rows: Column, names: Column, columns: Column | None = None) -> Column:
    """The first rule a table breaks, or ok. ``columns``: the column count (else that of the names)."""
    v = M.flat(rows)
    n = F.size(v)
    empty = M.count(v, C.missing)
    filled_columns = M.count(M.by_column(rows, lambda c, i: M.share(c, C.missing)), lambda s: s < 0.9)
    return (
        F.when(F.size(rows) < 1, "too_few_rows").when((columns if columns is not None else F.size(names)) < 2, "too_few_columns")
        .when(is_front_matter(rows, names) | is_contents(rows, names), "front_matter").when(is_prose(rows), "prose_text").when(F.forall(rows, R.is_index_legend), "index_legend_only")
        .when(Q.corruption(rows)["score"] > 0.4, "garbled_source").when(empty > 0.85 * n, "mostly_empty").when(filled_columns < 2, "single_column_list")
        .when((n <= 30) & F.exists(v, lambda x: F.coalesce(x, F.lit("")).rlike(FOOTER)), "page_footer_fragment")
        .when(M.count(v, lambda x: C.strip(x).rlike(C.RUN_OF_NUMBERS)) > 0.15 * n, "merged_rows").otherwise("ok")
    )
