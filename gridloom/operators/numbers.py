"""Numeric columns of packed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C


def is_castable(values: Column, threshold: float = 0.8) -> Column:
    """Most cells that say something are single numbers, and none holds two."""
    v = F.filter(F.transform(values, C.strip), lambda x: ~F.lower(x).isin("", "nan", "none"))
    judged = F.filter(v, lambda x: ~F.lower(x).isin(*C.NUMERIC_PLACEHOLDERS))
    return (F.size(judged) > 0) & ~F.exists(v, lambda x: x.rlike(C.MERGED)) & (M.share(judged, lambda x: x.rlike(C.CASTABLE)) >= threshold)


def castable_columns(rows: Column, threshold: float = 0.8) -> Column:
    return M.by_column(rows, lambda v, i: is_castable(v, threshold))


def typed_cells(tables: DataFrame, *keep: str, threshold: float = 0.8) -> DataFrame:
    """One row per cell: ``v`` as it is, ``num`` where the column is castable, ``is_int`` for whole numbers."""
    flagged = tables.withColumn("_cast", castable_columns(F.col("rows"), threshold))
    long = M.cells(flagged, *keep, "_cast")
    long = long.withColumn("castable", F.get("_cast", F.col("col_idx"))).drop("_cast")
    num = F.when(F.col("castable"), C.to_number(F.col("v")))
    return long.withColumn("num", num).withColumn("is_int", F.col("num") == F.floor("num"))
