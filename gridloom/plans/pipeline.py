"""The canonical chain from raw grids to stitched, named, typed and validated tables.

After one shuffle that packs each table, the steps up to validation are expressions on its row; stitching
shuffles one metadata row per table, then the kept rows by group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import text as X
from gridloom.operators import bookkeeping as B
from gridloom.operators import headers as H
from gridloom.operators import naming as N
from gridloom.operators import numbers as NU
from gridloom.operators import quality as Q
from gridloom.operators import rows as R
from gridloom.operators import stitch as ST
from gridloom.operators import structure as S
from gridloom.operators import validate as V


@dataclass(frozen=True)
class Options:
    phrases: tuple[tuple[str, str], ...] = ()
    terms: tuple[tuple[str, str], ...] = ()
    exact: tuple[tuple[str, str], ...] = ()
    drop_second_district: bool = True
    keep_trailing_banner: bool = False
    distinct_after_stitch: bool = True
    threshold: float = 0.8


def headed(tables: DataFrame, options: Options = Options()) -> DataFrame:
    """``doc_id, table_id, page, caption, rows`` to ``..., name, archetype, names, rows``."""
    t = tables.withColumn("rows", R.clean_rows(F.col("rows")))
    t = S.split_panels(t).drop("names")
    t = t.withColumn("rows", S.reassemble_wrapped(F.col("rows")))
    if options.phrases or options.exact:
        said = lambda v: X.translate(v, list(options.phrases), list(options.terms), list(options.exact))
        t = t.withColumn("rows", F.transform("rows", lambda r: F.transform(r, said)))
    t = t.withColumn("archetype", Q.archetype(F.col("rows"))["archetype"]).withColumn("h", H.header_rows(F.col("rows")))
    t = t.withColumn("name", N.table_name(F.col("rows"), F.col("h"), F.col("caption")))
    t = H.clean_headers(H.apply_headers(t, options.keep_trailing_banner), options.drop_second_district).drop("h")
    return S.lift_sections(t.withColumn("rows", S.merge_continued(F.col("rows"))))


def validated(tables: DataFrame, options: Options = Options()) -> DataFrame:
    t = headed(tables, options)
    return t.withColumn("reason", V.reason(F.col("rows"), F.col("names"))).withColumn("best_score", Q.score(F.col("rows"), F.col("names"))["score"])


def run(tables: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    """``tables`` (stitched and named), ``cells`` (typed), ``catalog``, ``quarantine``; takes what ``plans.extraction`` gives, or any tables."""
    checked = validated(tables, options)
    kept = M.only(checked, lambda x: x["reason"] == "ok")
    items = kept.select("doc_id", "table_id", F.col("page").cast("int").alias("page"), "name", F.size("rows").alias("n_rows"), "names")
    whole = B.fallback_names(ST.stitch(kept, ST.stitched_items(items), options.distinct_after_stitch))
    tried = F.col("strategies_tried") if "strategies_tried" in checked.columns else F.lit("given")
    quarantine = M.only(checked, lambda x: x["reason"] != "ok").select("doc_id", F.col("table_id").alias("table"), "page", "reason", "best_score", tried.alias("strategies_tried"))
    return {"tables": whole, "cells": NU.typed_cells(whole, threshold=options.threshold), "catalog": B.catalog(whole), "quarantine": quarantine}
