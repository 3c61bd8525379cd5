"""The relations and how they go from one form to the other.

``grid``    doc_id, table_id, row_idx, cells ARRAY<STRING>: one row per grid row
``tables``  doc_id, table_id, ..., rows ARRAY<ARRAY<STRING>> [, names ARRAY<STRING>]: one row per table
``cells``   doc_id, table_id, row_idx, col_idx, v: one row per cell

A table is what one report page holds, so a packed table is bounded. Packing is the one shuffle of a
chain: every operator on ``rows`` is a Column expression, so the operators after it fuse into one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("doc_id", "table_id")
ROWS = "array<array<string>>"


def pack(grid: DataFrame, *keep: str) -> DataFrame:
    """Grid rows to one row per table; ``keep``: columns that are constant in a table."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda r: r["cells"])
    return grid.groupBy(*KEYS).agg(rows.alias("rows"), *(F.any_value(k).alias(k) for k in keep))


def unpack(tables: DataFrame, *keep: str) -> DataFrame:
    """Packed tables to grid rows, renumbered from 0."""
    return tables.select(*KEYS, *keep, F.posexplode("rows").alias("row_idx", "cells"))


def cells(tables: DataFrame, *keep: str) -> DataFrame:
    """Packed tables to one row per cell."""
    return unpack(tables, *keep).select(*KEYS, *keep, "row_idx", F.posexplode("cells").alias("col_idx", "v"))


def only(df: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """A filter that stays above the long expressions it looks at.

    As a plain filter it would be pushed through every projection below, each time with that step's
    expression in place of its name; as a generator it isn't.
    """
    return df.select(F.inline(F.filter(F.array(F.struct("*")), test)))


# -- expressions on packed rows ---------------------------------------------------------------------


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, though ``use`` names it often."""
    return F.transform(F.array(value), use)[0]


def height(rows: Column) -> Column:
    return F.size(rows)


def width(rows: Column) -> Column:
    return F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0))


def flat(rows: Column) -> Column:
    return F.flatten(rows)


def column(rows: Column, i: Column) -> Column:
    return F.transform(rows, lambda r: F.get(r, i))


def by_column(rows: Column, use: Callable[[Column, Column], Column]) -> Column:
    """One value per column, from its cells and its index."""
    return F.transform(indices(width(rows)), lambda i: use(column(rows, i), i))


def indices(n: Column) -> Column:
    """0 .. n-1, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def count(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test))


def share(values: Column, test: Callable[[Column], Column]) -> Column:
    """The share of values that pass; 0 for none."""
    return F.when(F.size(values) > 0, count(values, test) / F.size(values)).otherwise(0.0)


def head(rows: Column, n: int | Column) -> Column:
    return F.slice(rows, 1, n)


def tail(rows: Column, start: Column) -> Column:
    """Rows from index ``start`` on."""
    return F.slice(rows, start + 1, F.greatest(F.size(rows) - start, F.lit(0)))


def first_index(values: Column, test: Callable[[Column], Column]) -> Column:
    """The index of the first value that passes; null for none."""
    hits = F.filter(F.transform(values, lambda v, i: F.when(test(v), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))
