"""Sources: grids as CSV, HTML or Parquet, files with a magic check, page scopes and kinds, scorecards."""

from __future__ import annotations


from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F




def source_status(content: Column) -> Column:
    """ok for a PDF's first bytes; a web page in its place is a bot redirect."""
    head = F.lower(F.decode(F.substring(content, 1, 200), "ISO-8859-1"))
    html = F.substring(head, 1, 15).contains("<!doctype") | head.contains("<html")
    return F.when(F.decode(F.substring(content, 1, 5), "ISO-8859-1") == "%PDF-", "ok").when(html, "invalid_source:bot_redirect").otherwise("invalid_source")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, status`` of every file; a file that isn't what it says is a row, not an error."""
    return spark.read.format("binaryFile").load(path).select("path", "length", source_status(F.col("content")).alias("status"), "content")


def page_scope(pages: None | int | str | Iterable[int]) -> list[int] | None:
    """None is every page; a number, numbers or "3,7-9" are those."""
    if pages is None:
        return None
    if isinstance(pages, int):
        return [pages]
    if isinstance(pages, str):
        out: set[int] = set()
        for part in filter(None, (p.strip() for p in pages.split(","))):
            a, _, b = part.partition("-")
            out.update(range(int(a), int(b or a) + 1))
        return sorted(out)
    return sorted({int(p) for p in pages})


def in_scope(df: DataFrame, pages, column: str = "page") -> DataFrame:
    """A filter that reaches the scan."""
    scope = page_scope(pages)
    return df if scope is None else df.filter(F.col(column).isin(scope))


def page_batches(pages: DataFrame, size: int = 25) -> DataFrame:
    """Pages with their batch, partitioned by it: the unit of work of a page reader."""
    return pages.withColumn("batch", F.floor((F.col("page") - 1) / size).cast("int")).repartition("doc_id", "batch")


def page_kind(chars: Column, image_area: Column, page_area: Column) -> Column:
    """text from six characters on, image when pictures cover four fifths, else blank."""
    cover = F.when(page_area > 0, image_area / page_area).otherwise(0.0)
    return F.when(chars >= 6, "text").when(cover >= 0.8, "image").otherwise("blank")


def scan_verdict(pages: DataFrame) -> DataFrame:
    """Per document the counts of page ``kind``s, the scanned share and the verdict, over all pages."""
    n = lambda k: F.count_if(F.col("kind") == k)
    t = pages.groupBy("doc_id").agg(F.count("*").alias("pages_total"), n("text").alias("text"), n("image").alias("image"), n("blank").alias("blank"))
    share = F.when(F.col("text") + F.col("image") > 0, F.round(F.col("image") / (F.col("text") + F.col("image")), 3)).otherwise(0.0)
    verdict = F.when(F.col("text") + F.col("image") == 0, "empty").when(F.col("scanned_fraction") >= 0.6, "scanned").when(F.col("scanned_fraction") >= 0.15, "mixed").otherwise("text")
    return t.withColumn("scanned_fraction", share).withColumn("verdict", verdict)


def stream_gate(accuracy: Column, whitespace: Column, n_rows: Column, n_cols: Column) -> Column:
    """Is a table found by white space alone good enough to keep?"""
    return (accuracy >= 80) & (whitespace <= F.when(accuracy >= 95, 70).otherwise(60)) & (n_rows >= 4) & (n_cols >= 3)


def read_csv_grid(spark: SparkSession, path: str, doc_id: int = 0) -> DataFrame:
    """CSV tables as grid rows of strings, one table per file; empty cells stay empty strings.

    A file's lines keep their order by offset inside the file, never by Spark's row order.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    row_list = F.filter(F.split("value", r"\r?\n(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda x: x != "")
    fields = lambda line: F.transform(F.split(line, r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda f: F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"')))
    table_id = F.coalesce(F.regexp_extract("file", r"table_([0-9]+)\.csv$", 1).try_cast("long"), F.xxhash64("file"))
    return raw.select(F.lit(doc_id).cast("long").alias("doc_id"), table_id.alias("table_id"), F.posexplode(F.transform(row_list, fields)).alias("row_idx", "cells"))


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The tables of web pages as grid rows."""
    inner = lambda tag, x: F.regexp_extract_all(x, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "(?s)<[^>]*>", " "), r"\s+", " "))
    t = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(inner("table", F.col(html_col))).alias("table_id", "_t"))
    return t.select("doc_id", F.col("table_id").cast("long"), F.posexplode(inner("tr", F.col("_t"))).alias("row_idx", "_r")).select("doc_id", "table_id", "row_idx", F.transform(inner("t[hd]", F.col("_r")), bare).alias("cells"))


def read_scorecards(spark: SparkSession, folder: str) -> DataFrame:
    """Measurement files of documents, without those that begin with an underscore or hold an error."""
    df = spark.read.option("multiLine", True).json(f"{folder}/[!_]*.json")
    return df.filter("error is null") if "error" in df.columns else df


def pick_lower_corruption(before: Column, after: Column, original: Column, recovered: Column) -> Column:
    """A second reading is taken only for bad soup (0.3 and more) and only when strictly less corrupt."""
    return F.when((before["score"] >= 0.3) & (before["dominant"] == "kruti") & (after["score"] < before["score"]), recovered).otherwise(original)


def rename_grouped(names: Column) -> Column:
    """Names like "NFHS-6 Urban" of an outside reader: the survey carries on to the columns that only say urban, rural or total."""
    wave = lambda n: F.regexp_extract(F.lower(n), r"nfhs[\s\-–]*([0-9])", 1)
    sub = lambda n: F.regexp_extract(F.lower(n), r"(urban|rural|total)", 1)

    def one(n: Column, i: Column) -> Column:
        last = F.element_at(F.filter(F.transform(F.slice(names, F.lit(1), i + 1), wave), lambda w: w != ""), F.lit(-1))
        some = F.exists(F.slice(names, F.lit(1), i + 1), lambda x: wave(x) != "")
        return F.when(i == 0, "indicator").when(some, F.concat_ws("_", F.concat(F.lit("nfhs"), last), F.nullif(sub(n), F.lit("")))).otherwise(n)

    return F.when(F.exists(names, lambda n: wave(n) != ""), F.transform(names, one)).otherwise(names)


