"""String grids rendered from the driver tables by rules on their keys, in SQL that Spark and DuckDB both run.

Each yields doc_id, table_id, row_idx and text columns c0, c1, ...; tables stay small whatever the scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_V = "CAST(floor(o_totalprice) AS BIGINT)"
_COMMA = f"CAST(CAST(floor({_V} / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST({_V} % 1000 AS STRING), 3, '0')"
_T = "CAST(floor(o_orderkey / 64) AS BIGINT)"
_ROW = "CAST(row_number() OVER (PARTITION BY floor(o_orderkey / 64) ORDER BY o_orderkey) - 1 AS INT)"
_HEAD = f"SELECT CAST(floor(o_orderkey / 64) AS BIGINT) % 8 AS doc_id, {_T} AS table_id, {_ROW} AS row_idx"

#: Amounts in every written form, whole numbers, merged values in every third table, labels.
AMOUNTS = f"""{_HEAD},
 'Order ' || o_orderstatus || ' item' AS c0,
 CASE o_orderkey % 9 WHEN 0 THEN CAST({_V} AS STRING) WHEN 1 THEN {_COMMA} WHEN 2 THEN '(' || {_COMMA} || ')'
   WHEN 3 THEN CAST({_V} % 90 AS STRING) || '.' || CAST({_V} % 7 AS STRING) || '%' WHEN 4 THEN {_COMMA} || '*' WHEN 5 THEN '-'
   WHEN 6 THEN 'n.a.' WHEN 7 THEN '-' || CAST({_V} AS STRING) ELSE CAST({_V} AS STRING) || '.50' END AS c1,
 CAST({_V} % 1000 AS STRING) AS c2,
 CASE WHEN {_T} % 3 = 0 AND o_orderkey % 4 = 0 THEN CAST({_V} AS STRING) || ' (' || CAST({_V} % 500 AS STRING) || ')' ELSE CAST({_V} AS STRING) END AS c3,
 CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 6 = 1 THEN 'nan' ELSE substr(o_orderpriority, 3) END AS c4
FROM orders"""

#: Amounts with four numbers and more run together in one cell: in a fifth of the cells, a fifteenth, or none.
RUNS = f"""SELECT doc_id, table_id, row_idx, c0, c1,
 CASE WHEN table_id % 3 = 1 OR table_id % 3 = 2 AND row_idx % 3 = 0 THEN c2 || ' 1,200 (35) 4.5% ' || c2 ELSE c2 END AS c2, c3, c4 FROM ({AMOUNTS}) z"""

#: Amounts in Devanagari and Arabic-Indic digits, alone and among ASCII ones.
SCRIPTS = f"""SELECT doc_id, table_id, row_idx, translate(c2, '0123456789', '०१२३४५६७८९') AS c0,
 CASE WHEN row_idx % 3 = 0 THEN '1,' || translate(lpad(c2, 3, '0'), '0123456789', '०१२३४५६७८९') WHEN row_idx % 3 = 1 THEN '(' || translate(c2, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ')' ELSE c2 || '*' END AS c1,
 translate(c2 || '.5%', '0123456789', '٠١٢٣٤٥٦٧٨٩') AS c2 FROM ({AMOUNTS}) z"""

#: Rows of twelve kinds: years, months, data, serials, legends, sub-headers, numbers or labels alone, blanks.
KINDS = f"""SELECT doc_id, table_id, row_idx,
 CASE k WHEN 0 THEN 'Year' WHEN 1 THEN 'Month' WHEN 2 THEN 'Total of all' WHEN 3 THEN CAST(n % 90 + 1 AS STRING) WHEN 4 THEN '1' WHEN 5 THEN ''
   WHEN 6 THEN '' WHEN 7 THEN '41. Mothers who' WHEN 8 THEN 'received care' WHEN 9 THEN 'Women' WHEN 10 THEN 'unnamed col' ELSE '' END AS c0,
 CASE k WHEN 0 THEN '2011' WHEN 1 THEN 'Jan' WHEN 2 THEN CAST(n AS STRING) WHEN 3 THEN 'Name' WHEN 4 THEN '2' WHEN 5 THEN 'Rural' WHEN 6 THEN CAST(n % 97 AS STRING) || '.5' ELSE '' END AS c1,
 CASE k WHEN 0 THEN '2012-13' WHEN 1 THEN 'February' WHEN 2 THEN '1,' || lpad(CAST(n % 1000 AS STRING), 3, '0') WHEN 3 THEN '12' WHEN 4 THEN '(3)' WHEN 5 THEN 'Urban' WHEN 6 THEN '(7.25)' WHEN 11 THEN 'x' ELSE '' END AS c2,
 CASE k WHEN 0 THEN '2014' WHEN 1 THEN 'Mar.' WHEN 2 THEN '3.5' WHEN 3 THEN '7' WHEN 4 THEN '4' WHEN 5 THEN 'Total' WHEN 6 THEN '' ELSE '' END AS c3,
 CASE k WHEN 0 THEN '20' || CAST(10 + n % 5 AS STRING) WHEN 1 THEN CASE WHEN n % 2 = 0 THEN 'Apr' ELSE 'June' END WHEN 2 THEN '-4' WHEN 3 THEN '9' WHEN 4 THEN '5' WHEN 5 THEN '' WHEN 6 THEN '8%' ELSE '' END AS c4
FROM (SELECT CAST(floor(c_custkey / 48) AS BIGINT) % 8 AS doc_id, CAST(floor(c_custkey / 48) AS BIGINT) AS table_id,
        CAST(row_number() OVER (PARTITION BY floor(c_custkey / 48) ORDER BY c_custkey) - 1 AS INT) AS row_idx,
        c_custkey AS n, CAST((c_custkey * 7) % 12 AS INT) AS k FROM customer) t"""

#: A banner row for each region, then its nations; continuation rows after some.
SECTIONS = """SELECT 0 AS doc_id, s AS table_id, CAST(row_number() OVER (PARTITION BY s ORDER BY rk, nk, part) - 1 AS INT) AS row_idx, c0, c1, c2 FROM (
 SELECT s, r_regionkey AS rk, -1 AS nk, 0 AS part, r_name AS c0, '' AS c1, '' AS c2 FROM region CROSS JOIN (SELECT DISTINCT s_nationkey % 4 AS s FROM supplier) x
 UNION ALL
 SELECT s, n_regionkey, n_nationkey, 1, n_name, CAST((n_nationkey * 37 + s) % 100 AS STRING) || ',' || lpad(CAST((n_nationkey * 91) % 1000 AS STRING), 3, '0'), CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE CAST(n_nationkey * 3 AS STRING) || '.5' END
   FROM nation CROSS JOIN (SELECT DISTINCT s_nationkey % 4 AS s FROM supplier) x
 UNION ALL
 SELECT s, n_regionkey, n_nationkey, 2, '', '', '(' || CAST(n_nationkey AS STRING) || ')' FROM nation CROSS JOIN (SELECT DISTINCT s_nationkey % 4 AS s FROM supplier) x WHERE n_nationkey % 5 = s
) y"""

#: Two panels side by side in even tables, one wide table in odd ones.
PANELS = """SELECT 0 AS doc_id, CAST(floor(c_custkey / 40) AS BIGINT) AS table_id, CAST(row_number() OVER (PARTITION BY floor(c_custkey / 40) ORDER BY c_custkey) - 1 AS INT) AS row_idx,
 CASE WHEN floor(c_custkey / 40) % 2 = 1 OR c_custkey % 2 = 0 THEN c_name ELSE '' END AS c0,
 CASE WHEN floor(c_custkey / 40) % 2 = 1 OR c_custkey % 2 = 0 THEN CAST(c_custkey % 300 AS STRING) ELSE '' END AS c1,
 CASE WHEN floor(c_custkey / 40) % 2 = 1 OR c_custkey % 2 = 1 THEN c_mktsegment ELSE '' END AS c2,
 CASE WHEN floor(c_custkey / 40) % 2 = 1 OR c_custkey % 2 = 1 THEN CAST(c_nationkey AS STRING) ELSE '' END AS c3,
 CASE WHEN floor(c_custkey / 40) % 2 = 1 OR c_custkey % 2 = 1 THEN '1.5' ELSE '' END AS c4
FROM customer"""

#: Survey fact sheets: labels apart (0, 4), one cell over the first two (1) or the second and third (2) value columns, pages that go on (3); two more columns in 4.
SURVEYS = """SELECT 0 AS doc_id, CAST(s_suppkey AS BIGINT) AS table_id, CAST(i AS INT) AS row_idx,
 CASE WHEN k = 3 OR i > 2 THEN CAST(i AS STRING) || '. Share of ' || s_name WHEN i = 1 THEN 'Indicators' WHEN i = 2 THEN 'Population' ELSE '' END AS c0,
 CASE WHEN k = 3 OR i > 2 THEN CAST((s_suppkey * 7 + i) % 90 AS STRING) || '.5' WHEN i = 2 AND k IN (0, 4) THEN 'Urban' WHEN i = 2 AND k = 1 THEN 'Urban Rural' ELSE '' END AS c1,
 CASE WHEN k = 3 OR i > 2 THEN '(' || CAST(i AS STRING) || ')' WHEN i = 0 THEN 'NFHS-' || CAST(4 + s_suppkey % 3 AS STRING) WHEN i = 1 THEN '(2023-24)' WHEN k IN (0, 4) THEN 'Rural' WHEN k = 2 THEN 'Urban  Rural' ELSE '' END AS c2,
 CASE WHEN k = 3 OR i > 2 THEN '*' WHEN i = 2 THEN 'Total' ELSE '' END AS c3,
 CASE WHEN k = 3 OR i > 2 THEN '4,870' WHEN i = 0 THEN 'nfhs ' || CAST(3 + s_suppkey % 2 AS STRING) WHEN i = 1 THEN '(2019-21)' ELSE 'Total' END AS c4,
 CASE WHEN k <> 4 THEN NULL WHEN i = 2 THEN 'Total' WHEN i > 2 AND i % 2 = 0 THEN '9' ELSE '' END AS c5,
 CASE WHEN k <> 4 THEN NULL WHEN i > 2 THEN '1' ELSE '' END AS c6
FROM (SELECT s_suppkey, s_name, s_suppkey % 5 AS k, i FROM supplier CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) q) z"""

#: Tables stacked under titles.
STACKS = """SELECT 0 AS doc_id, CAST(floor(s_suppkey / 20) AS BIGINT) AS table_id, CAST(row_number() OVER (PARTITION BY floor(s_suppkey / 20) ORDER BY s_suppkey) - 1 AS INT) AS row_idx,
 CASE WHEN s_suppkey % 7 = 0 THEN 'Table 1.' || CAST(s_suppkey AS STRING) ELSE s_name END AS c0,
 CASE WHEN s_suppkey % 7 = 0 THEN 'Suppliers' ELSE CAST(s_nationkey AS STRING) END AS c1,
 CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE CAST(s_suppkey * 3 AS STRING) END AS c2
FROM supplier"""

#: Columns of codes, serials, months, states, years, per cents, dates, names; one table per block.
ROLES = """SELECT 0 AS doc_id, CAST(floor(p_partkey / 30) AS BIGINT) AS table_id, CAST(row_number() OVER (PARTITION BY floor(p_partkey / 30) ORDER BY p_partkey) - 1 AS INT) AS row_idx,
 CAST(p_partkey % 9000 + 1000 AS STRING) || '.' || lpad(CAST(p_partkey % 100 AS STRING), 2, '0') AS c0,
 CAST(row_number() OVER (PARTITION BY floor(p_partkey / 30) ORDER BY p_partkey) AS STRING) AS c1,
 CASE p_partkey % 4 WHEN 0 THEN 'Jan' WHEN 1 THEN 'August' WHEN 2 THEN 'sept' ELSE 'Dec 2020' END AS c2,
 CASE p_partkey % 3 WHEN 0 THEN 'Kerala' WHEN 1 THEN '17. Gujarat' ELSE 'Haryana- 4' END AS c3,
 CAST(1950 + p_partkey % 70 AS STRING) || '-' || lpad(CAST((51 + p_partkey % 70) % 100 AS STRING), 2, '0') AS c4,
 CAST(p_partkey % 100 AS STRING) || '.5%' AS c5,
 CASE WHEN p_partkey % 5 = 0 THEN '' ELSE lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0') || '/02/2024' END AS c6,
 'Part ' || p_brand || ' of ' || p_type AS c7,
 CAST(p_size AS STRING) AS c8
FROM part"""

#: Rows that repeat, garbage rows, white space.
DIRTY = """SELECT 0 AS doc_id, CAST(floor(l_orderkey / 16) AS BIGINT) AS table_id, CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 16) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS row_idx,
 CASE WHEN l_partkey % 11 = 0 THEN 'Unnamed: 0' WHEN l_partkey % 11 = 1 THEN NULL ELSE '  ' || l_returnflag || '   ' || l_linestatus || ' ' END AS c0,
 CASE WHEN l_partkey % 11 = 1 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS c1,
 CASE WHEN l_partkey % 11 = 1 THEN NULL WHEN l_partkey % 5 = 0 THEN '' ELSE 'k' || CAST(l_partkey % 3 AS STRING) END AS c2
FROM lineitem"""

#: Monthly pieces of a nation's table: pages, names, some without headers.
PIECES = """SELECT n_nationkey AS doc_id, n_nationkey * 100 + p AS table_id, CAST(p + CASE WHEN p >= 4 THEN 5 ELSE 0 END AS INT) AS page,
 CASE WHEN p IN (0, 4) THEN 'Table ' || CAST(n_regionkey + 1 AS STRING) || '.' || CAST(p + 1 AS STRING) || ' Orders' WHEN p = 2 AND n_nationkey % 2 = 0 THEN 'Note on orders' END AS name,
 CAST(6 + (n_nationkey + p) % 5 AS INT) AS n_rows, CASE WHEN p IN (1, 5) AND n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS headless
FROM nation CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) q"""

#: Words of a page: labels at the left, values that end on four columns, with jitter.
WORDS = """SELECT CAST(floor(l_orderkey / 32) AS BIGINT) AS doc_id, 1 AS page, 200.0 + 100.0 * (l_linenumber % 4) + (l_partkey % 3) - 30.0 AS x0,
 200.0 + 100.0 * (l_linenumber % 4) + (l_partkey % 3) AS x1, 10.0 * (l_orderkey % 32) AS top, CAST(l_partkey % 900 + 100 AS STRING) AS text
FROM lineitem
UNION ALL
SELECT CAST(floor(o_orderkey / 32) AS BIGINT), 1, 10.0, 60.0, 10.0 * (o_orderkey % 32), 'Item ' || o_orderstatus FROM orders"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Shared SQL over the tables it names."""
    import re

    for t in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def grid(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Grid rows of a shared SQL text."""
    df = query(spark, sf_dir, sql)
    width = [c for c in df.columns if c[0] == "c" and c[1:].isdigit()]
    return df.select("doc_id", F.col("table_id").cast("long").alias("table_id"), "row_idx", F.array(*width).alias("cells"))


def long(sql: str, columns: int) -> str:
    """The cells of a shared grid as rows, for both engines."""
    parts = " UNION ALL ".join(f"SELECT doc_id, table_id, row_idx, {k} AS col_idx, c{k} AS v FROM g" for k in range(columns))
    return f"g AS ({sql}), cells AS ({parts})"
