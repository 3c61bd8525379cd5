"""Titles and headers from the page around a table: caption search, headers read back by place.

Relations: ``lines(doc_id, page, top, text)`` and ``words(doc_id, page, x0, x1, top, text)`` are packed per
page, which bounds them; ``boxes`` are tables with their place and column ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C
from gridloom.operators import rows as R

# Explicit titles, numbered sections, lines of units, bands in shares of a page or points.
TITLE_LINE = r"(?i)^(table|tabel|statement|annexure|appendix)\s*[\(\-:.]?\s*\p{Nd}"
SECTION_LINE = r"^\p{Nd}{1,2}(\.\p{Nd}{1,2})+[\s\-–:]+[A-Z]"
TITLE_INSIDE = r"(?i)\b(table|tabel|statement|annexure|appendix)\b\s*\p{Nd}"
UNIT_LINE = r"(?i)₹|crore|per cent|\blakh\b|million|billion|base\s*[:y]|end-march|end-"
FRAME, FRAME_BAND, TOP, PREVIOUS, HEADER_BAND = 0.85, 0.2, 0.15, 0.7, 58.0
PAGE = ("doc_id", "page")


def title_of(lines: Column) -> Column:
    """The nearest explicit title (with a lower-case line after it), else numbered section (with a bracketed one), else heading."""

    def nearest(test, absorbs) -> Column:
        hits = F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())

        def text(at: Column) -> Column:
            after = F.get(lines, at + 1)
            return F.when(F.coalesce(absorbs(after), F.lit(False)), F.concat_ws(" ", F.get(lines, at), after)).otherwise(F.get(lines, at))

        return F.when(F.size(hits) > 0, M.bind(F.element_at(hits, F.lit(-1)), text))

    explicit = nearest(lambda x: x.rlike(TITLE_LINE), lambda x: x.rlike(r"^\p{Ll}") & ~x.rlike(TITLE_LINE))
    section = nearest(lambda x: x.rlike(SECTION_LINE) & (F.length(x) < 90), lambda x: x.startswith("("))
    heading = nearest(R.is_heading_line, lambda x: F.lit(False))
    return F.substring(F.coalesce(explicit, section, heading), 1, 300)


def captions(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """``boxes(doc_id, page, table_id, top, bottom, height)`` with a ``caption``: above the table, inside a frame's top, at the foot of the page before, else the two lines above."""
    page = lines.filter("trim(text) <> ''").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("top", F.trim("text").alias("text")))).alias("_l"))
    before = page.select("doc_id", (F.col("page") + 1).alias("page"), F.col("_l").alias("_p"))
    t = boxes.join(page, list(PAGE), "left").join(before, list(PAGE), "left")
    none = F.array().cast("array<struct<top:double,text:string>>")
    t = t.withColumn("_l", F.coalesce("_l", none)).withColumn("_p", F.coalesce("_p", none))
    text = lambda x: F.transform(x, lambda k: k["text"])
    span = F.col("bottom") - F.col("top")
    t = t.withColumn("_above", text(F.filter("_l", lambda x: x["top"] < F.col("top"))))
    t = t.withColumn("_band", text(F.filter("_l", lambda x: (span > FRAME * F.col("height")) & (x["top"] >= F.col("top")) & (x["top"] <= F.col("top") + FRAME_BAND * span))))
    t = t.withColumn("_foot", text(F.filter("_p", lambda x: (F.col("top") < TOP * F.col("height")) & (x["top"] >= PREVIOUS * F.col("height")))))
    last = F.array_join(F.slice("_above", F.greatest(F.size("_above") - 1, F.lit(1)), F.lit(2)), " ")
    caption = F.coalesce(title_of(F.col("_above")), title_of(F.col("_band")), title_of(F.col("_foot")), F.nullif(F.substring(last, 1, 300), F.lit("")))
    return t.withColumn("caption", caption).drop("_l", "_p", "_above", "_band", "_foot")


def bucketed(words: Column, columns: Column) -> Column:
    """The text of each column range from the words whose middles it is the first to hold."""

    def first(w: Column) -> Column:
        mid = (w["x0"] + w["x1"]) / 2
        return M.first_index(columns, lambda c: (c["lo"] <= mid) & (mid <= c["hi"]))

    placed = F.transform(words, lambda w: F.struct(F.round(w["top"]).alias("top"), w["x0"].alias("x0"), w["text"].alias("text"), first(w).alias("c")))
    return M.bind(F.array_sort(placed), lambda p: F.transform(columns, lambda c, i: F.array_join(F.transform(F.filter(p, lambda w: w["c"] == i), lambda w: w["text"]), " ")))


def _with_words(tables: DataFrame, words: DataFrame) -> DataFrame:
    own = words.filter("trim(text) <> ''").groupBy(*PAGE).agg(F.collect_list(F.struct("top", "x0", "x1", "text")).alias("_w"))
    return tables.join(own, list(PAGE), "left").withColumn("_w", F.coalesce("_w", F.array().cast("array<struct<top:double,x0:double,x1:double,text:string>>")))


def repair_headers(tables: DataFrame, words: DataFrame) -> DataFrame:
    """A lone cell of three words in the top four rows is read again by place (P8): ``tables(..., rows, row_tops, columns)``.

    ``row_tops`` holds the bounds of the rows, ``columns`` the ranges ``(lo, hi)``; three filled cells are needed.
    """
    t = _with_words(tables, words)

    def repaired(r: Column, i: Column) -> Column:
        own = F.filter("_w", lambda w: (w["top"] >= F.get("row_tops", i) - 1) & (w["top"] < F.get("row_tops", i + 1) + 1))
        fires = (i < 4) & (F.size(R.non_empty(r)) == 1) & (C.word_count(F.array_join(r, " ")) >= 3)
        return M.bind(bucketed(own, F.col("columns")), lambda b: F.when(fires & (M.count(b, lambda v: v != "") >= 3), b).otherwise(r))

    return t.withColumn("rows", F.transform("rows", repaired)).drop("_w")


def recover_headers(tables: DataFrame, words: DataFrame, pad: float = 16.0, missing: Column | None = None) -> DataFrame:
    """A missing header is read from the band above the table and put first (P9): ``tables(..., rows, top, columns)``.

    Lines that are titles, or units in at most three words, don't count; half of the columns must get a text, three at least.
    ``missing`` tells whether a header is missing where the rows have changed since.
    """
    t = _with_words(tables, words).withColumn("_w", F.filter("_w", lambda w: (w["top"] >= F.col("top") - HEADER_BAND) & (w["top"] <= F.col("top") + pad)))
    line = lambda w: F.round(w["top"] / 3)

    def dropped(w: Column) -> Column:
        own = F.filter("_w", lambda x: line(x) == line(w))
        text = F.array_join(F.transform(F.array_sort(F.transform(own, lambda x: F.struct(x["x0"], x["text"]))), lambda x: x["text"]), " ")
        return text.rlike(TITLE_INSIDE) | (text.rlike(UNIT_LINE) & (F.size(own) <= 3))

    t = t.withColumn("_b", bucketed(F.filter("_w", lambda w: ~dropped(w)), F.col("columns")))
    filled = M.count(F.col("_b"), lambda v: v != "")
    missing = R.header_missing(F.col("rows")) if missing is None else missing
    fires = missing & (filled >= F.greatest(F.lit(3.0), 0.5 * F.size("_b"))) & (F.size("_b") == M.width(F.col("rows")))
    return t.withColumn("rows", F.when(fires, F.concat(F.array(F.col("_b")), F.col("rows"))).otherwise(F.col("rows"))).drop("_w", "_b")
