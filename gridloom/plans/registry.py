"""Registered queries: each operator on a grid rendered from the driver tables, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C
from gridloom.functions import text as X
from gridloom.operators import bookkeeping as B
from gridloom.operators import geometry as G
from gridloom.operators import headers as H
from gridloom.operators import layout as L
from gridloom.operators import naming as N
from gridloom.operators import numbers as NU
from gridloom.operators import quality as Q
from gridloom.operators import rows as R
from gridloom.operators import stitch as ST
from gridloom.operators import structure as S
from gridloom.operators import validate as V
from gridloom.plans import extraction as EX
from gridloom.plans import grids as D
from gridloom.sources import readers as RD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = list(M.KEYS)

# RE2 forms of the cell patterns, for the SQL side.
NUM = r"^\(?-?[0-9,]+(\.[0-9]+)?%?\)?$"
CAST = r"^[(\-+−]?\s*[0-9,]+(\.[0-9]+)?\s*[)%*†§¶#‡]?$"
MERGED = r"[0-9][0-9,]*(\.[0-9]+)?\s+[(]?[0-9]"
HOLD = "('', 'nan', 'none', '-', '–', '—', '−', 'n.a.', 'na', 'n/a', 'nil', '..', '...', '*', 'neg', 'negligible')"
MISS = "('', 'nan', 'None')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def packed(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return M.pack(D.grid(spark, sf_dir, sql))


def per_table(name: str, grid: str, use: Callable, sql: str) -> None:
    """A query of one expression per packed table."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return packed(spark, sf_dir, grid).select(*KEYS, *use(F.col("rows")))


def per_row(name: str, grid: str, test: Callable, flag: str) -> None:
    """A query of one predicate per row; ``flag``: its SQL over c0, c1, ..."""

    @query(name, f"WITH g AS ({grid}) SELECT doc_id, table_id, row_idx, coalesce({flag}, false) AS flag FROM g")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = D.grid(spark, sf_dir, grid)
        return g.select(*KEYS, "row_idx", F.coalesce(test(F.col("cells")), F.lit(False)).alias("flag"))


# -- numbers ----------------------------------------------------------------------------------------

NUMBER_SQL = r"""CASE WHEN lower(trim(v)) IN {hold} THEN NULL ELSE
 CASE WHEN v LIKE '(%)' THEN -1 ELSE 1 END * try_cast(replace(regexp_replace(regexp_replace(v, '[%*]+$', ''), '[()]', '', 'g'), ',', '') AS DOUBLE) END""".replace("{hold}", HOLD)
CASTABLE_SQL = f"""SELECT doc_id, table_id, col_idx,
  count(*) FILTER (lower(v) NOT IN {HOLD}) > 0 AND count(*) FILTER (lower(v) NOT IN ('', 'nan', 'none') AND regexp_matches(v, '{MERGED}')) = 0
  AND count(*) FILTER (lower(v) NOT IN {HOLD} AND regexp_matches(v, '{CAST}')) >= 0.8 * count(*) FILTER (lower(v) NOT IN {HOLD}) AS castable
  FROM cells GROUP BY ALL"""


@query("f1_to_number", f"WITH {D.long(D.AMOUNTS, 5)} SELECT doc_id, table_id, row_idx, {NUMBER_SQL} AS num FROM cells WHERE col_idx = 1")
def _(spark, sf_dir):
    g = D.grid(spark, sf_dir, D.AMOUNTS)
    return g.select(*KEYS, "row_idx", C.to_number(F.col("cells")[1]).alias("num"))


@query("f1b_to_number_of_scripts", f"WITH {D.long(D.SCRIPTS, 3)} SELECT doc_id, table_id, row_idx, col_idx, CASE WHEN v LIKE '(%' THEN -1 ELSE 1 END * CAST(replace(translate(regexp_replace(v, '[()%*]', '', 'g'), '०१२३४५६७८९٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), ',', '') AS DOUBLE) AS num, true AS number FROM cells")
def _(spark, sf_dir):
    """Numbers in other scripts' digits."""
    g = D.grid(spark, sf_dir, D.SCRIPTS).select(*KEYS, "row_idx", F.posexplode("cells").alias("col_idx", "v"))
    return g.select(*KEYS, "row_idx", "col_idx", C.to_number(F.col("v")).alias("num"), (C.is_number(F.col("v")) | F.col("v").rlike(C.CASTABLE)).alias("number"))


@query("f3b_typed_cells_of_scripts", f"WITH {D.long(D.SCRIPTS, 3)} SELECT doc_id, table_id, avg(CASE WHEN v LIKE '(%' THEN -1 ELSE 1 END * CAST(replace(translate(regexp_replace(v, '[()%*]', '', 'g'), '०१२३४५६७८९٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), ',', '') AS DOUBLE)) AS mean, count(*) AS n FROM cells GROUP BY ALL")
def _(spark, sf_dir):
    """Columns of such numbers are castable, every cell of them."""
    t = NU.typed_cells(packed(spark, sf_dir, D.SCRIPTS))
    return t.groupBy(*KEYS).agg(F.avg("num").alias("mean"), F.count("num").alias("n"))


@query("f2_castable_columns", f"WITH {D.long(D.AMOUNTS, 5)} {CASTABLE_SQL}")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, D.AMOUNTS)
    return t.select(*KEYS, F.posexplode(NU.castable_columns(F.col("rows"))).alias("col_idx", "castable"))


@query("f3_typed_cells", f"WITH {D.long(D.AMOUNTS, 5)}, k AS ({CASTABLE_SQL}) SELECT doc_id, table_id, row_idx, col_idx, v, CASE WHEN castable THEN {NUMBER_SQL} END AS num FROM cells JOIN k USING (doc_id, table_id, col_idx)")
def _(spark, sf_dir):
    return NU.typed_cells(packed(spark, sf_dir, D.AMOUNTS)).select(*KEYS, "row_idx", "col_idx", "v", "num")


per_table("a8_numeric_fraction", D.AMOUNTS, lambda r: [Q.numeric_fraction(r).alias("frac")],
          f"WITH {D.long(D.AMOUNTS, 5)} SELECT doc_id, table_id, coalesce(count(*) FILTER (trim(v) NOT IN {MISS} AND regexp_matches(trim(v), '{NUM}')) / nullif(count(*) FILTER (trim(v) NOT IN {MISS}), 0)::DOUBLE, 0) AS frac FROM cells GROUP BY ALL")


@query("a9_column_numeric_share", f"WITH {D.long(D.AMOUNTS, 5)} SELECT doc_id, table_id, col_idx, coalesce(count(*) FILTER (trim(v) NOT IN {MISS} AND regexp_matches(trim(v), '{NUM}')) / nullif(count(*) FILTER (trim(v) NOT IN {MISS}), 0)::DOUBLE, 0) AS share FROM cells GROUP BY ALL")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, D.AMOUNTS)
    return t.select(*KEYS, F.posexplode(M.by_column(F.col("rows"), lambda v, i: M.share(R.non_empty(v), lambda x: x.rlike(C.NUMBER)))).alias("col_idx", "share"))


@query("k7_written_number", f"WITH g AS ({D.AMOUNTS}) SELECT doc_id, table_id, row_idx, CASE WHEN regexp_matches(c1, '^-?[0-9]+$') THEN 'int' WHEN regexp_matches(c1, '^-?[0-9]*\\.[0-9]+$') THEN 'float' ELSE 'text' END AS kind, CASE WHEN regexp_matches(c1, '^-?[0-9]+$|^-?[0-9]*\\.[0-9]+$') THEN CAST(c1 AS DOUBLE) END AS num FROM g")
def _(spark, sf_dir):
    return D.grid(spark, sf_dir, D.AMOUNTS).select(*KEYS, "row_idx", B.written_number(F.col("cells")[1]).alias("w")).select(*KEYS, "row_idx", "w.kind", "w.num")


# -- scores and metrics -----------------------------------------------------------------------------

SCORE_HOLD = "('-', '–', '—', '−', 'na', 'n.a.', 'n/a', 'nil', '..', '...', '*')"
VALUE = r"(?i)^\(?([0-9]{4}\s*[-–]\s*[0-9]{2,4}|(rs\.?|₹|inr)\s*[0-9,]+(\.[0-9]+)?\s*(lakh|lakhs|crore|cr\.?|thousand|k)?|[0-9,]+(\.[0-9]+)?\s*(lakh|lakhs|crore|cr\.?|%)|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{1,3}[.)])\)?$"
RUN = r"^(\(?-?[0-9,]+(\.[0-9]+)?%?\)?\s+){3,}\(?-?[0-9,]+(\.[0-9]+)?%?\)?$"
SCORE_SQL = f"""c AS (SELECT *, trim(v) NOT IN {MISS} AS filled, trim(v) NOT IN {MISS} AND lower(trim(v)) NOT IN {SCORE_HOLD} AS content,
   regexp_matches(trim(v), '{NUM}') OR regexp_matches(trim(v), '{VALUE}') AS isnum, regexp_matches(v, '[A-Za-z]{{2,}}') AS texty,
   len(list_filter(string_split_regex(trim(v), '\\s+'), lambda x: x <> '')) AS words, regexp_matches(trim(v), '{RUN}') AS run FROM cells),
 p AS (SELECT doc_id, table_id, col_idx, avg(filled::INT) >= 0.5 AS full_col FROM c GROUP BY ALL),
 h AS (SELECT doc_id, table_id, avg(full_col::INT) AS coherence FROM p GROUP BY ALL),
 a AS (SELECT doc_id, table_id, count(*) FILTER (content)::DOUBLE AS n, avg(filled::INT) AS fill, count(*) FILTER (content AND isnum) / n AS nd, count(*) FILTER (content AND texty) / n AS td,
   count(*) FILTER (content AND NOT isnum AND texty AND words <= 6) / n AS label, count(*) FILTER (content AND run) / n AS merged FROM c GROUP BY doc_id, table_id),
 s AS (SELECT doc_id, table_id, coherence, fill, nd, merged, nd < 0.30 AND td >= 0.60 AND fill >= 0.60 AS text_mode,
   0.4 * CASE WHEN nd < 0.30 AND td >= 0.60 AND fill >= 0.60 THEN td ELSE nd + label END + 0.4 * coherence + 0.2 * fill AS raw FROM a JOIN h USING (doc_id, table_id))"""


FINAL_SQL = "CASE WHEN merged > 0.15 THEN least(round_even(raw, 3), 0.45) WHEN merged > 0.05 THEN round_even(greatest(round_even(raw, 3) - 0.15, 0), 3) ELSE round_even(raw, 3) END"


@query("a2_score_table", f"WITH {D.long(D.RUNS, 5)}, {SCORE_SQL} SELECT doc_id, table_id, {FINAL_SQL} AS score, round_even(nd, 3) AS numeric_density, round_even(coherence, 3) AS header_coherence, round_even(fill, 3) AS fill_rate, round_even(merged, 3) AS merged_frac, text_mode FROM s")
def _(spark, sf_dir):
    return packed(spark, sf_dir, D.RUNS).select(*KEYS, Q.score(F.col("rows")).alias("s")).select(*KEYS, "s.*")


@query("a4_kept_flags", f"WITH {D.long(D.RUNS, 5)}, {SCORE_SQL} SELECT doc_id, table_id, {FINAL_SQL} < 0.70 AS low_quality, {FINAL_SQL} < 0.50 AS review_needed FROM s")
def _(spark, sf_dir):
    s = packed(spark, sf_dir, D.RUNS).select(*KEYS, Q.score(F.col("rows")).alias("s"))
    return s.select(*KEYS, Q.kept_flags(F.col("s.score")).alias("f")).select(*KEYS, "f.*")


ATTEMPTS = "SELECT CAST(floor(o_orderkey / 3) AS BIGINT) AS table_id, CAST(o_orderkey % 3 AS INT) AS attempt, CASE o_orderkey % 3 WHEN 0 THEN 'lattice' WHEN 1 THEN 'stream' ELSE 'edge' END AS strategy, CAST((o_orderkey * 13) % 10 AS DOUBLE) / 10 AS score FROM orders"


@query("a3_best_attempts", f"WITH a AS ({ATTEMPTS}) SELECT table_id, arg_max(strategy, score * 100 - attempt) AS strategy, max(score) AS best_score, string_agg(strategy, '>' ORDER BY attempt) AS tried FROM a GROUP BY table_id")
def _(spark, sf_dir):
    b = Q.best_attempts(D.query(spark, sf_dir, ATTEMPTS), "table_id")
    return b.select("table_id", "strategy", "best_score", F.array_join(F.transform("attempts", lambda a: a["strategy"]), ">").alias("tried"))


SCRIPTS = "SELECT 0 AS doc_id, CAST(floor(p_partkey / 25) AS BIGINT) AS table_id, CAST(p_partkey % 25 AS INT) AS row_idx, CASE (p_partkey * p_size) % 6 WHEN 0 THEN 'जिला' WHEN 1 THEN 'ftyk' WHEN 2 THEN '' WHEN 3 THEN 'nan' ELSE 'District' END AS c0, CASE WHEN p_size % 3 = 0 THEN 'dqy ;ksx' ELSE CAST(p_size AS STRING) END AS c1 FROM part"


@query("a5_corruption", f"WITH {D.long(SCRIPTS, 2)}, k AS (SELECT *, CASE WHEN v IN ('', 'nan') THEN NULL WHEN v = 'जिला' THEN 'deva' WHEN v IN ('ftyk', 'dqy ;ksx') THEN 'kruti' ELSE '' END AS kind FROM cells) SELECT doc_id, table_id, count(*) FILTER (kind <> '') / count(kind)::DOUBLE AS score, CASE WHEN count(*) FILTER (kind <> '') = 0 THEN NULL WHEN count(*) FILTER (kind = 'deva') >= count(*) FILTER (kind = 'kruti') THEN 'deva' ELSE 'kruti' END AS dominant, count(*) FILTER (kind <> '') / count(kind)::DOUBLE >= 0.3 AS corrupt FROM k GROUP BY ALL")
def _(spark, sf_dir):
    return packed(spark, sf_dir, SCRIPTS).select(*KEYS, Q.corruption(F.col("rows")).alias("c")).select(*KEYS, "c.*", (F.col("c.score") >= 0.3).alias("corrupt"))


CODES = "SELECT 0 AS doc_id, CAST(floor(p_partkey / 20) AS BIGINT) AS table_id, CAST(p_partkey % 20 AS INT) AS row_idx, CASE WHEN floor(p_partkey / 20) % 3 = 0 THEN CAST(1000 + p_partkey % 500 AS STRING) || '.0100' WHEN p_partkey % 20 < 2 THEN 'Head' ELSE CAST(p_partkey AS STRING) END AS c0, CASE WHEN floor(p_partkey / 20) % 3 = 1 THEN CAST(p_size AS STRING) || '.5' ELSE p_type || ' grade' END AS c1 FROM part"


@query("a7_archetype", f"""WITH {D.long(CODES, 2)}, b AS (SELECT * FROM cells WHERE row_idx > 0 OR table_id IN (SELECT table_id FROM g GROUP BY table_id HAVING count(*) = 1 OR min(row_idx) > 0)),
 c AS (SELECT doc_id, table_id, count(*)::DOUBLE AS n, count(*) FILTER (len(regexp_extract_all(v, '[A-Za-z]{{2,}}')) >= 2) AS txt,
   count(*) FILTER (regexp_matches(v, '^\\(?-?[0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]+)?\\)?%?$|^\\(?-?[0-9]+\\.[0-9]{{1,2}}\\)?%?$|^-?[0-9]{{1,2}}(\\.[0-9]+)?%$') AND NOT regexp_matches(v, '^[0-9]{{3,4}}\\.[0-9]{{2,4}}$')) AS mea,
   count(DISTINCT row_idx)::DOUBLE AS nrow, count(DISTINCT CASE WHEN regexp_matches(v, '^[0-9]{{3,4}}\\.[0-9]{{2,4}}$') THEN row_idx END) AS cod FROM b WHERE lower(trim(v)) NOT IN ('', 'nan', 'none', '-', '–', '—') GROUP BY ALL)
 SELECT doc_id, table_id, CASE WHEN n >= 4 AND nrow >= 3 AND cod / nrow >= 0.4 AND txt / n >= 0.25 AND mea / n < 0.15 THEN 'reference' ELSE 'statistical' END AS archetype,
   CASE WHEN n < 4 OR nrow < 3 THEN 0 ELSE round_even(cod / nrow, 3) END AS code_row_frac, CASE WHEN n < 4 OR nrow < 3 THEN 0 ELSE round_even(txt / n, 3) END AS text_cell_frac, CASE WHEN n < 4 OR nrow < 3 THEN 0 ELSE round_even(mea / n, 3) END AS measure_cell_frac FROM c""")
def _(spark, sf_dir):
    return packed(spark, sf_dir, CODES).select(*KEYS, Q.archetype(F.col("rows")).alias("a")).select(*KEYS, "a.*")


per_table("h2_reference_header_rows", CODES, lambda r: [Q.reference_header_rows(r).alias("h")],
          f"WITH g AS ({CODES}), r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS i FROM g) SELECT doc_id, table_id, CAST(coalesce(min(i) FILTER (i < 8 AND (regexp_matches(c0, '^\\(?[0-9]{{1,4}}(\\.[0-9]{{1,4}})?\\)?$') AND c0 NOT IN ('0', '(0)') OR regexp_matches(c1, '^\\(?[0-9]{{1,4}}(\\.[0-9]{{1,4}})?\\)?$'))), CASE WHEN count(*) > 1 THEN 1 ELSE 0 END) AS INT) AS h FROM r GROUP BY ALL")

NAMES = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'col_' || CAST(c_custkey % 7 AS STRING) WHEN 1 THEN 'value' WHEN 2 THEN 'rural_' || lower(c_mktsegment) WHEN 3 THEN 'gross_output_' || CAST(1990 + c_custkey % 30 AS STRING) ELSE 'name' END AS name FROM customer"


@query("a11_composite_columns", f"WITH n AS ({NAMES}) SELECT c_custkey, len(string_split(name, '_')) >= 3 OR (len(string_split(name, '_')) = 2 AND (name LIKE 'rural_%' OR regexp_matches(name, '_(19|20)[0-9]{{2}}$'))) AS composite FROM n")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, NAMES).select("c_custkey", Q.is_composite(F.col("name")).alias("composite"))


@query("a10_measure_table", f"""WITH {D.long(D.AMOUNTS, 5)}, c AS (SELECT *, trim(v) NOT IN {MISS} AS filled, regexp_matches(trim(v), '{NUM}') AS num, {NUMBER_SQL} IS NOT NULL AS typed FROM cells),
 k AS (SELECT doc_id, table_id, col_idx, count(*) FILTER (filled) AS n, count(*) FILTER (filled AND num) / count(*) FILTER (filled)::DOUBLE AS alike, count(*) FILTER (filled AND typed) / count(*) FILTER (filled)::DOUBLE AS typed FROM c GROUP BY ALL),
 r AS (SELECT doc_id, table_id, avg(typed) FILTER (alike >= 0.5 AND n > 0) AS numeric_readiness, count(*) FILTER (alike >= 0.5 AND n > 0) AS intended_numeric_cols, count(*) FILTER (typed >= 0.8) AS numeric_cols FROM k GROUP BY ALL)
 SELECT doc_id, table_id, count(DISTINCT row_idx) AS rows, 5 AS cols, count(*) FILTER (filled AND num AND col_idx > 0) / count(*) FILTER (filled AND col_idx > 0)::DOUBLE AS numeric_value_frac, any_value(numeric_readiness) AS numeric_readiness, any_value(intended_numeric_cols) AS intended_numeric_cols, any_value(numeric_cols) AS numeric_cols FROM c JOIN r USING (doc_id, table_id) GROUP BY ALL""")
def _(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("label", "value", "value_2", "gross_total_2020", "col_4")))
    t = packed(spark, sf_dir, D.AMOUNTS).select(*KEYS, Q.metrics(F.col("rows"), names, F.lit(None).cast("string")).alias("m"))
    return t.select(*KEYS, "m.rows", "m.cols", "m.numeric_value_frac", "m.numeric_readiness", "m.intended_numeric_cols", "m.numeric_cols")


MEASURED = "SELECT o_orderkey AS table_id, CAST(o_orderkey % 5 AS DOUBLE) / 5 AS col_n_frac, CAST(o_orderkey % 3 AS INT) AS dup_cols, o_orderkey % 7 = 0 AS has_category, CAST(o_orderkey % 2 AS INT) AS composite_cols, CAST(o_orderkey % 11 AS DOUBLE) / 11 AS numeric_value_frac, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 9 AS DOUBLE) / 9 END AS numeric_readiness, CAST(o_orderkey % 50 AS INT) - 48 AS orphan_rows, CAST(o_orderkey % 6 AS INT) - 4 AS deva_rows, o_orderkey % 10 > 2 AS named FROM orders"


@query("a12_corpus_scorecard", f"WITH m AS ({MEASURED}) SELECT count(*) AS total_tables, avg(col_n_frac) AS mean_col_n_frac, avg((dup_cols > 0)::INT) AS dup_cols_frac, avg(has_category::INT) AS category_frac, avg((composite_cols > 0)::INT) AS composite_frac, avg(numeric_value_frac) AS mean_numeric_value_frac, avg(numeric_readiness) AS mean_numeric_readiness, avg((orphan_rows > 0)::INT) AS orphan_table_frac, avg((deva_rows > 0)::INT) AS deva_leak_frac, avg(named::INT) AS named_frac FROM m")
def _(spark, sf_dir):
    return Q.scorecard(D.query(spark, sf_dir, MEASURED))


CHECKED = "SELECT o_custkey % 40 AS doc_id, o_orderkey AS table_id, CAST(o_orderkey % 90 AS INT) AS page, CASE o_orderkey % 6 WHEN 0 THEN 'prose_text' WHEN 1 THEN 'front_matter' ELSE 'ok' END AS reason FROM orders"


@query("a13_document_summary", f"WITH v AS ({CHECKED}), r AS (SELECT doc_id, reason, count(*) AS n FROM v GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS found, CAST(coalesce(sum(n) FILTER (reason = 'ok'), 0) AS BIGINT) AS passed, coalesce(string_agg(reason || ':' || n, ',' ORDER BY reason) FILTER (reason <> 'ok'), '') AS failed FROM r GROUP BY doc_id")
def _(spark, sf_dir):
    s = Q.document_summary(D.query(spark, sf_dir, CHECKED))
    return s.select("doc_id", "found", "passed", F.array_join(F.transform("failed_reasons", lambda x: F.concat_ws(":", x["reason"], x["n"].cast("string"))), ",").alias("failed"))


@query("k11_result_stats", f"WITH v AS ({CHECKED}) SELECT count(*) AS found, count(*) FILTER (reason = 'ok') AS extracted, count(*) FILTER (reason <> 'ok') AS set_aside, max(page) AS max_page FROM v")
def _(spark, sf_dir):
    return B.result_stats(D.query(spark, sf_dir, CHECKED))


PAIRS = "SELECT c_mktsegment AS key, CASE WHEN c_custkey % 3 = 0 THEN 'Segment ' || substr(c_mktsegment, 1, 1) || 'x' WHEN c_custkey % 3 = 1 THEN 'Market Part' ELSE 'low case' END AS label, c_custkey AS ord FROM customer"


@query("a14_learn_map", f"WITH p AS ({PAIRS}), n AS (SELECT key, label, count(*) AS n, min(ord) AS f FROM p WHERE regexp_matches(label, '^[A-Z][A-Za-z]+([ .][A-Za-z]+)*$') AND length(label) >= 4 AND label <> key GROUP BY ALL) SELECT key, label, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, f) AS r FROM n) WHERE r = 1 AND n >= 2")
def _(spark, sf_dir):
    return B.learn_map(D.query(spark, sf_dir, PAIRS))


@query("a16_csv_quality", "SELECT p_partkey, 100 - 50 * (p_size % 6)::DOUBLE / 6 - CASE WHEN p_partkey % 9 < 5 THEN 30 ELSE 0 END AS score, 100 - 50 * (p_size % 6)::DOUBLE / 6 - CASE WHEN p_partkey % 9 < 5 THEN 30 ELSE 0 END >= 60 AS good FROM part")
def _(spark, sf_dir):
    p = D.query(spark, sf_dir, "SELECT * FROM part")
    return p.select("p_partkey", Q.csv_quality(F.lit(6.0), F.col("p_size") % 6, F.col("p_partkey") % 9).alias("q")).select("p_partkey", "q.*")


# -- rows -------------------------------------------------------------------------------------------

REST = "[c1, c2, c3, c4]"
FILLED = f"list_filter({REST}, lambda x: trim(x) NOT IN ('', 'nan', 'None'))"
ALL5 = "list_filter([c0, c1, c2, c3, c4], lambda x: trim(x) NOT IN ('', 'nan', 'None'))"
N_NUM = f"len(list_filter({REST}, lambda x: regexp_matches(trim(x), '{NUM}')))"
per_row("p10_year_header", D.KINDS, R.is_year_header, f"len({FILLED}) >= 3 AND len(list_filter({FILLED}, lambda x: regexp_matches(x, '[0-9]{{4}}[-–][0-9]{{2}}|^(19|20)[0-9]{{2}}$'))) >= greatest(3, 0.7 * len({FILLED}))")
per_row("p11_month_header", D.KINDS, R.is_month_header, f"len({FILLED}) >= 3 AND len(list_filter({FILLED}, lambda x: regexp_matches(lower(x), '^(jan|feb|february|mar|apr|june?|july?)\\.?$'))) >= greatest(3, 0.7 * len({FILLED}))")
per_row("p12_data_row", D.KINDS, R.is_data, f"len({ALL5}) >= 3 AND len(list_filter({ALL5}, lambda x: try_cast(replace(x, ',', '') AS DOUBLE) IS NOT NULL)) >= 3 AND (regexp_matches(c0, '^[0-9]+$') OR len(list_filter({ALL5}, lambda x: try_cast(replace(x, ',', '') AS DOUBLE) IS NOT NULL)) >= 0.6 * len({ALL5}))")
per_row("p13_index_legend", D.KINDS, R.is_index_legend, "c0 = '1' AND c1 = '2' AND c2 = '(3)' AND c3 = '4' AND c4 = '5'")
per_row("p14_sub_header", D.KINDS, lambda r: R.is_sub_header(r, F.lit(5)), f"len({ALL5}) >= 2 AND len(list_filter({ALL5}, lambda x: regexp_matches(x, '{NUM}') OR NOT regexp_matches(x, '[A-Za-z]'))) = 0 AND regexp_matches(lower(list_aggregate({ALL5}, 'string_agg', ' ')), '\\b(rural|urban|total)\\b')")
per_row("p15_numeric_only", D.KINDS, R.is_numeric_only, f"trim(c0) = '' AND {N_NUM} >= 2")
per_row("p15_label_only", D.KINDS, R.is_label_only, f"trim(c0) <> '' AND {N_NUM} = 0")
per_row("p17_orphan_row", D.KINDS, R.is_orphan, f"trim(c0) IN {MISS} AND {N_NUM} >= 2")
per_row("p3_garbage_row", D.KINDS, R.is_garbage, "lower(c0) LIKE 'unnamed%'")
per_table("w9_data_start", D.KINDS, lambda r: [R.data_start(r).alias("start")],
          f"WITH g AS ({D.KINDS}) SELECT doc_id, table_id, min(row_idx) FILTER ({SQL['p12_data_row'].split('coalesce(')[1].rsplit(', false)', 1)[0]}) AS start FROM g GROUP BY ALL")

LINES = "SELECT doc_id, text FROM documents"


@query("p16_heading_lines", f"""WITH l AS (SELECT doc_id, CAST(i AS INT) AS line, trim(t) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
 w AS (SELECT *, list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '') AS ws FROM l)
 SELECT doc_id, count(*) AS lines, count(*) FILTER (len(ws) BETWEEN 2 AND 16 AND regexp_matches(s, '^\\p{{L}}') AND NOT regexp_matches(s, '^\\p{{Ll}}') AND NOT regexp_matches(s, '[.;]\\s|[.;]$|:$')
  AND length(replace(s, ')', '')) >= length(replace(s, '(', '')) AND length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) >= 0.6 * length(replace(s, ' ', ''))
  AND (len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= greatest(2, len(ws) * 0.5) OR regexp_matches(lower(s), '\\b(distribution|number|percentage|proportion|ratio|rate|trends?|share|estimate[ds]?|coverage|prevalence|growth|index|average|summary|profile|indicators?|statistics?|status|composition|classification|state[\\s\\-]?wise|district[\\s\\-]?wise|category[\\s\\-]?wise|by\\s+(age|sex|state|district|sector|type|group|category|level))\\b'))) AS headings FROM w GROUP BY doc_id""")
def _(spark, sf_dir):
    d = D.query(spark, sf_dir, LINES).withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    return d.filter("text is not null").select("doc_id", F.size("lines").cast("long").alias("lines"), M.count(F.col("lines"), R.is_heading_line).cast("long").alias("headings"))


@query("p1_clean_rows", f"""WITH g AS ({D.DIRTY}), k AS (SELECT doc_id, table_id, row_idx, trim(regexp_replace(coalesce(c0, ''), '\\s+', ' ', 'g')) AS c0, coalesce(c1, '') AS c1, coalesce(c2, '') AS c2, c0 IS NULL AND c1 IS NULL AND c2 IS NULL AS gone FROM g),
 u AS (SELECT doc_id, table_id, c0, c1, c2, min(row_idx) AS row_idx FROM k WHERE NOT gone AND NOT starts_with(lower(c0), 'unnamed') GROUP BY ALL)
 SELECT doc_id, table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS INT) AS row_idx, c0 || '|' || c1 || '|' || c2 AS cells FROM u""")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, D.DIRTY).withColumn("rows", R.clean_rows(F.col("rows")))
    return M.unpack(t).select(*KEYS, "row_idx", F.array_join("cells", "|").alias("cells"))


WRAPS = "SELECT n_nationkey, 'Grie' || chr(10) || 'vances ' || chr(10) || 'brought' || chr(10) || n_name || chr(10) || '4  x' AS v FROM nation"


@query("p2_normal_cell", "SELECT n_nationkey, 'Grievances brought ' || n_name || ' 4 x' AS v FROM nation")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, WRAPS).select("n_nationkey", R.normal_cell(F.col("v")).alias("v"))


CRUSHED = "SELECT 0 AS doc_id, CAST(floor(c_custkey / 10) AS BIGINT) AS table_id, CAST(c_custkey % 10 AS INT) AS row_idx, CASE WHEN c_custkey % 37 = 0 THEN '1' || chr(10) || '2' || chr(10) || '3' || chr(10) || '4.5' ELSE 'a' END AS c0, CASE WHEN floor(c_custkey / 10) % 5 = 0 THEN 'x' || chr(10) || 'y' || chr(10) || 'z' ELSE 'b' END AS c1 FROM customer"
per_table("p5_is_crushed", CRUSHED, lambda r: [R.is_crushed(r).alias("crushed")],
          f"WITH {D.long(CRUSHED, 2)} SELECT doc_id, table_id, count(*) FILTER (length(v) - length(replace(v, chr(10), '')) >= 2) > 0.25 * count(*) OR count(*) FILTER (starts_with(v, '1' || chr(10))) > 0 AS crushed FROM cells GROUP BY ALL")

CRUSHED_HEAD = "SELECT 0 AS doc_id, c_custkey AS table_id, 0 AS row_idx, CASE WHEN c_custkey % 2 = 0 THEN 'Name' || chr(10) || 'Urban' || chr(10) || 'Rural' || chr(10) || 'All' ELSE 'Name' END AS c0, '' AS c1, '' AS c2 FROM customer"


@query("p6_spread_header", f"WITH g AS ({CRUSHED_HEAD}) SELECT table_id, CASE WHEN table_id % 2 = 0 THEN 'Name|Urban|Rural All' ELSE 'Name||' END AS cells FROM g")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, CRUSHED_HEAD).withColumn("rows", R.spread_crushed_header(F.col("rows")))
    return M.unpack(t).select("table_id", F.array_join("cells", "|").alias("cells"))


HEADS = "SELECT 0 AS doc_id, c_custkey AS table_id, CAST(i AS INT) AS row_idx, CASE i WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'A long sparse title block here' ELSE 'State' END ELSE CAST(i AS STRING) END AS c0, CASE WHEN i = 0 AND c_custkey % 3 = 1 THEN 'Urban' WHEN i > 0 THEN '5' ELSE '' END AS c1, CASE WHEN i = 0 AND c_custkey % 3 = 1 THEN 'Rural' WHEN i > 0 THEN '6' ELSE '' END AS c2 FROM customer CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) q"
per_table("p7_header_missing", HEADS, lambda r: [R.header_missing(r).alias("missing")], f"WITH g AS ({HEADS}) SELECT DISTINCT doc_id, table_id, table_id % 3 <> 1 AS missing FROM g")


# -- structure --------------------------------------------------------------------------------------

CELLS3 = "array_to_string([c0, c1, c2], '|')"


def rows_out(t: DataFrame, *more: str) -> DataFrame:
    return M.unpack(t, *more).select(*KEYS, *more, "row_idx", F.array_join("cells", "|").alias("cells"))


LABELLED = f"""b AS (SELECT *, CASE WHEN c0 <> '' AND c1 = '' AND c2 = '' THEN 'L' WHEN c1 <> '' OR c2 <> '' THEN 'D' ELSE 'B' END AS k FROM g),
 n AS (SELECT *, lead(k) OVER (PARTITION BY table_id ORDER BY row_idx) AS nk FROM b),
 s AS (SELECT *, last_value(CASE WHEN k = 'L' THEN c0 END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row_idx) AS cat FROM n)"""


@query("w2_lift_sections", f"WITH g AS ({D.SECTIONS}), {LABELLED} SELECT doc_id, table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS INT) AS row_idx, cat || '|' || {CELLS3} AS cells FROM s WHERE k <> 'L'")
def _(spark, sf_dir):
    return rows_out(S.lift_sections(packed(spark, sf_dir, D.SECTIONS)))


CONTINUED = f"""k AS (SELECT *, c0 = '' AND (c1 <> '' OR c2 <> '') AS cont FROM g), h AS (SELECT *, sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY table_id ORDER BY row_idx) AS grp FROM k),
 m AS (SELECT doc_id, table_id, grp, min(row_idx) AS first_at, max(c0) AS c0, coalesce(string_agg(nullif(c1, ''), ' ' ORDER BY row_idx), '') AS c1, coalesce(string_agg(nullif(c2, ''), ' ' ORDER BY row_idx), '') AS c2 FROM h GROUP BY ALL)"""


@query("w3_merge_continued", f"WITH g AS ({D.SECTIONS}), {CONTINUED} SELECT doc_id, table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY first_at) - 1 AS INT) AS row_idx, {CELLS3} AS cells FROM m")
def _(spark, sf_dir):
    return rows_out(packed(spark, sf_dir, D.SECTIONS).withColumn("rows", S.merge_continued(F.col("rows"))))


WRAPPED = "SELECT 0 AS doc_id, c_custkey AS table_id, CAST(i AS INT) AS row_idx, CASE i WHEN 0 THEN 'Women' WHEN 1 THEN CAST(c_custkey % 90 AS STRING) || '. Mothers who' WHEN 2 THEN 'received care' WHEN 4 THEN 'within days' WHEN 5 THEN CASE WHEN c_custkey % 2 = 0 THEN '7. Next one' ELSE 'and more' END ELSE '' END AS c0, CASE WHEN i IN (3, 6) THEN CAST(c_custkey AS STRING) ELSE '' END AS c1, CASE WHEN i IN (3, 6) THEN '4.5' ELSE '' END AS c2 FROM customer CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) q"


@query("w4_reassemble_wrapped", f"""WITH g AS ({WRAPPED}), k AS (SELECT DISTINCT doc_id, table_id, table_id % 90 AS n, table_id % 2 = 0 AS even FROM g)
 SELECT doc_id, table_id, 0 AS row_idx, 'Women||' AS cells FROM k
 UNION ALL SELECT doc_id, table_id, 1, n || '. Mothers who received care within days' || CASE WHEN even THEN '' ELSE ' and more' END || '|' || table_id || '|4.5' FROM k
 UNION ALL SELECT doc_id, table_id, 2, CASE WHEN even THEN '7. Next one' ELSE '' END || '|' || table_id || '|4.5' FROM k""")
def _(spark, sf_dir):
    return rows_out(packed(spark, sf_dir, WRAPPED).withColumn("rows", S.reassemble_wrapped(F.col("rows"))))


@query("r6_split_side_by_side", f"""WITH g AS ({D.PANELS}), t AS (SELECT table_id, count(*) AS n, floor(any_value(table_id)) % 2 = 0 AS two FROM g GROUP BY table_id),
 p AS (SELECT g.doc_id, g.table_id, 0 AS part, row_idx, c0 || '|' || c1 AS cells FROM g JOIN t USING (table_id) WHERE two AND n >= 12 AND c0 <> ''
  UNION ALL SELECT g.doc_id, g.table_id, 1, row_idx, c2 || '|' || c3 || '|' || c4 FROM g JOIN t USING (table_id) WHERE two AND n >= 12 AND c2 <> ''
  UNION ALL SELECT g.doc_id, g.table_id, 0, row_idx, array_to_string([c0, c1, c2, c3, c4], '|') FROM g JOIN t USING (table_id) WHERE NOT (two AND n >= 12))
 SELECT doc_id, table_id, CAST(part AS INT) AS part, CAST(row_number() OVER (PARTITION BY table_id, part ORDER BY row_idx) - 1 AS INT) AS row_idx, cells FROM p""")
def _(spark, sf_dir):
    return rows_out(S.split_side_by_side(packed(spark, sf_dir, D.PANELS)), "part")


@query("r7_split_stacked", f"""WITH g AS ({D.STACKS}), f AS (SELECT *, row_idx > 0 AND starts_with(c0, 'Table') AS cut, count(*) OVER (PARTITION BY table_id) AS n FROM g),
 s AS (SELECT *, sum(cut::INT) OVER (PARTITION BY table_id ORDER BY row_idx) AS seg FROM f),
 z AS (SELECT table_id, seg, count(*) FILTER (NOT cut) AS size, max(CASE WHEN cut THEN c0 || ' ' || c1 END) AS title FROM s GROUP BY ALL),
 v AS (SELECT s.*, z.title, sum(CASE WHEN z.size >= CASE WHEN z.seg = 0 THEN 1 ELSE 2 END THEN 1 ELSE 0 END) OVER (PARTITION BY s.table_id) AS ok FROM s JOIN z USING (table_id, seg) WHERE NOT cut AND z.size >= CASE WHEN seg = 0 THEN 1 ELSE 2 END AND n >= 5)
 SELECT doc_id, table_id, CAST(dense_rank() OVER (PARTITION BY table_id ORDER BY seg) - 1 AS INT) AS part, title, CAST(row_number() OVER (PARTITION BY table_id, seg ORDER BY row_idx) - 1 AS INT) AS row_idx, {CELLS3} AS cells FROM v
 UNION ALL SELECT doc_id, table_id, 0, NULL, row_idx, {CELLS3} FROM f WHERE n < 5""")
def _(spark, sf_dir):
    return rows_out(S.split_stacked(packed(spark, sf_dir, D.STACKS)), "part", "title")


ENTRIES = "SELECT n_regionkey AS doc_id, n_regionkey AS table_id, 0 AS row_idx, 'Sl' AS c0, 'City' AS c1, 'Number' AS c2 FROM nation WHERE n_nationkey < 5 UNION ALL SELECT rk, rk, 1, e, '', '' FROM (SELECT n_regionkey AS rk, string_agg(CAST(n_nationkey + 1 AS STRING) || ' City' || translate(CAST(n_nationkey AS STRING), '0123456789', 'abcdefghij') || ' ' || CAST(n_nationkey AS STRING) || '.25', ' ') AS e FROM nation GROUP BY n_regionkey) q"


@query("s1_extracted_tables", f"""WITH g AS ({D.PANELS}), t AS (SELECT table_id, count(*) AS n, table_id % 2 = 0 AS two, count(*) FILTER (c0 <> '') AS l, count(*) FILTER (c2 <> '') AS r FROM g GROUP BY table_id),
 p AS (SELECT table_id, 0 AS part, CASE WHEN two AND n >= 12 THEN l ELSE n END AS n FROM t UNION ALL SELECT table_id, 1, r FROM t WHERE two AND n >= 12)
 SELECT CAST(row_number() OVER (ORDER BY table_id, part) AS BIGINT) AS table_id, CAST(table_id AS BIGINT) AS source_table, CAST(n AS INT) AS n, 'lattice' AS strategy, 'Chapter 1 Customers' AS caption FROM p""")
def _(spark, sf_dir):
    """Three attempts at each table: crushed, without its numbers, whole; the last one wins, and its panels come apart."""
    t = packed(spark, sf_dir, D.PANELS).withColumn("page", F.lit(1))
    t = t.withColumn("caption", F.when(F.col("table_id") == 0, "Chapter 1 Customers").otherwise(""))
    bare = F.transform("rows", lambda r: F.transform(r, lambda v: F.when(C.is_number(v), "").otherwise(v)))
    crushed = F.transform("rows", lambda r: F.array(F.concat(F.get(r, F.lit(0)), F.lit("\n1\n2\n3\n4"))))
    attempt = lambda strategy, k, rows: F.struct(F.lit(strategy).alias("strategy"), F.lit(k).alias("attempt"), rows.alias("rows"))
    tries = F.array(attempt("lattice", 0, crushed), attempt("stream", 1, bare), attempt("lattice", 2, F.col("rows")))
    tables = EX.extracted(t.select("doc_id", "page", "table_id", "caption", F.inline(tries)))
    return tables.select("table_id", "source_table", F.size("rows").alias("n"), "strategy", "caption")


@query("r8_split_panels", "WITH e AS (SELECT n_regionkey AS table_id, n_nationkey + 1 AS sl, 'City' || translate(CAST(n_nationkey AS STRING), '0123456789', 'abcdefghij') AS city, n_nationkey || '.25' AS v FROM nation) SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY sl) - 1 AS INT) AS row_idx, sl || '|' || city || '|' || v AS cells FROM e")
def _(spark, sf_dir):
    sql = ENTRIES.replace("string_agg(", "array_join(collect_list(").replace("|| '.25', ' ') AS e", "|| '.25'), ' ') AS e")
    return rows_out(S.split_panels(packed(spark, sf_dir, sql))).drop("doc_id")


GHOSTS = "SELECT 0 AS doc_id, CAST(floor(c_custkey / 12) AS BIGINT) AS table_id, CAST(c_custkey % 12 AS INT) AS row_idx, c_name AS c0, '' AS c1, CASE WHEN c_custkey % 24 = 0 THEN '5' ELSE '' END AS c2, CASE WHEN c_custkey % 2 = 0 THEN '7' ELSE '' END AS c3 FROM customer"


@query("r12_ghost_columns", f"WITH {D.long(GHOSTS, 4)}, k AS (SELECT doc_id, table_id, col_idx, count(*) FILTER (v <> '') AS filled, count(*)::DOUBLE AS n FROM cells GROUP BY ALL), s AS (SELECT *, filled > 0 AND (col_idx NOT IN (1, 2) OR filled / n >= 0.2) AS keep FROM k), t AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY table_id) AS kept FROM s) SELECT doc_id, table_id, string_agg(CASE col_idx WHEN 0 THEN 'name' WHEN 1 THEN 'col_1' WHEN 2 THEN 'col_2' ELSE 'value' END, '|' ORDER BY col_idx) AS names FROM t WHERE keep OR kept < 2 GROUP BY ALL")
def _(spark, sf_dir):
    names = F.array(*map(F.lit, ("name", "col_1", "col_2", "value")))
    return S.drop_ghosts(packed(spark, sf_dir, GHOSTS).withColumn("names", names)).select(*KEYS, F.array_join("names", "|").alias("names"))


@query("r13_lead_columns", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 's_no|district|area|rank' ELSE 's_no|area|rank' END AS names FROM nation")
def _(spark, sf_dir):
    n = D.query(spark, sf_dir, "SELECT n_nationkey FROM nation").withColumn("names", F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, ("area", "district", "rank", "s_no")))).otherwise(F.array(*map(F.lit, ("area", "s_no", "rank")))))
    order = S.lead_columns(F.col("names"), "s_no", "district")
    return n.select("n_nationkey", F.array_join(F.transform(order, lambda i: F.get("names", i)), "|").alias("names"))


FILLS = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE '' END AS c0, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE '' END AS c1, CASE WHEN c_custkey % 5 = 0 THEN 'c' ELSE '' END AS c2 FROM customer"


@query("w1_fill_right", f"WITH g AS ({FILLS}) SELECT c_custkey, c0 || '|' || coalesce(nullif(c1, ''), c0) || '|' || coalesce(nullif(c2, ''), nullif(c1, ''), c0) AS cells FROM g")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, FILLS).select("c_custkey", F.array_join(H.fill_right(F.array("c0", "c1", "c2")), "|").alias("cells"))


# -- headers and names ------------------------------------------------------------------------------

BANDS = "SELECT 0 AS doc_id, c_custkey AS table_id, CAST(i AS INT) AS row_idx, CASE i WHEN 0 THEN 'State' WHEN 1 THEN '' ELSE 'Area ' || CAST(i AS STRING) END AS c0, CASE WHEN i = 0 THEN CASE c_custkey % 4 WHEN 0 THEN '2011' WHEN 1 THEN 'Jan' WHEN 2 THEN 'Gross Output' ELSE 'Company' END WHEN i = 1 AND c_custkey % 4 = 2 THEN 'Rural' WHEN c_custkey % 4 = 3 AND i < 3 THEN 'text' ELSE '1,234' END AS c1, CASE WHEN i = 0 THEN CASE c_custkey % 4 WHEN 0 THEN '2012-13' WHEN 1 THEN 'Feb' WHEN 2 THEN '' ELSE 'Place' END WHEN i = 1 AND c_custkey % 4 = 2 THEN 'Urban' WHEN c_custkey % 4 = 3 THEN 'text' ELSE '45' END AS c2, CASE WHEN i = 0 THEN CASE c_custkey % 4 WHEN 1 THEN 'Mar' ELSE 'Rank' END WHEN c_custkey % 4 = 3 THEN 'word' ELSE '6.5' END AS c3 FROM customer CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) q"
per_table("h1_header_rows", BANDS, lambda r: [H.header_rows(r).alias("h")],
          f"""WITH {D.long(BANDS, 4)}, r AS (SELECT doc_id, table_id, row_idx, count(*) FILTER (v <> '')::DOUBLE AS n, count(*) FILTER (regexp_matches(v, '^-?[0-9,]+(\\.[0-9]+)?%?$')) AS num, count(*) FILTER (regexp_matches(v, '^(19|20)[0-9]{{2}}(-[0-9]{{2}})?$')) AS yr, count(*) FILTER (v IN ('Jan', 'Feb', 'Mar')) AS mon FROM cells GROUP BY ALL)
 SELECT doc_id, table_id, CAST(coalesce(max(row_idx) FILTER (mon >= 3) + 1, min(row_idx) FILTER (yr >= 2) + 1, CASE WHEN count(*) FILTER (num >= 2 AND num / n >= 0.5) > 0 THEN greatest(min(row_idx) FILTER (num >= 2 AND num / n >= 0.5), 1) END, CASE WHEN count(*) FILTER (num >= 1 AND num / n >= 0.3) > 0 THEN greatest(min(row_idx) FILTER (num >= 1 AND num / n >= 0.3), 1) END, 2) AS INT) AS h FROM r GROUP BY ALL""")  # fmt: skip


@query("h3_apply_headers", f"WITH g AS ({BANDS}) SELECT DISTINCT table_id, CASE table_id % 4 WHEN 0 THEN 'state|2011|2012_13|rank' WHEN 1 THEN 'state|jan|feb|mar' WHEN 2 THEN 'state|gross_output_rural|gross_output_urban|rank' ELSE 'state|company|place|rank' END AS names, CASE WHEN table_id % 4 >= 2 THEN 2 ELSE 3 END AS n FROM g")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, BANDS).withColumn("h", H.header_rows(F.col("rows")))
    return H.apply_headers(t).select("table_id", F.array_join("names", "|").alias("names"), F.size("rows").alias("n"))


SUBS = "SELECT 0 AS doc_id, c_custkey AS table_id, CAST(i AS INT) AS row_idx, CASE WHEN i = 0 THEN '' ELSE 'Area' END AS c0, CASE WHEN i = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Rural' ELSE '5' END ELSE '1,000' END AS c1, CASE WHEN i = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Urban' ELSE '6' END ELSE '7' END AS c2 FROM customer CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) q"


@query("h6_absorb_sub_headers", f"WITH g AS ({SUBS}) SELECT DISTINCT table_id, CASE WHEN table_id % 2 = 0 THEN 'state|output_rural|output_urban' ELSE 'state|output|output' END AS names, CASE WHEN table_id % 2 = 0 THEN 2 ELSE 3 END AS n FROM g")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, SUBS).withColumn("names", F.array(*map(F.lit, ("state", "output", "output"))))
    return H.absorb_sub_headers(t).select("table_id", F.array_join("names", "|").alias("names"), F.size("rows").alias("n"))


@query("h5_clean_header", "SELECT p_partkey, regexp_replace(regexp_replace(replace(regexp_replace(lower(p_type || ' -- Centre (No.) ' || p_brand), '[^a-z0-9]+', '_', 'g'), 'centre', 'center'), '^_|_$', '', 'g'), 'x^', '') AS h FROM part")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, "SELECT * FROM part").select("p_partkey", X.clean_header(F.concat("p_type", F.lit(" -- Centre (No.) "), "p_brand")).alias("h"))


MONTH_HEADS = "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Jan''25 Feb''25' ELSE 'Jan' END AS c1 FROM nation"


@query("h9_spread_months", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'state|jan|feb|mar' ELSE 'state|jan|col_2|mar' END AS names FROM nation")
def _(spark, sf_dir):
    band = F.array(F.array(F.lit("State"), F.col("c1"), F.lit(""), F.lit("Mar")))
    names = F.array(*map(F.lit, ("state", "jan", "col_2", "mar")))
    return D.query(spark, sf_dir, MONTH_HEADS).select("n_nationkey", F.array_join(H.spread_months(names, band), "|").alias("names"))


@query("h7_survey_headers", rf"""WITH {D.long(D.SURVEYS, 7)}, own AS (SELECT * FROM cells WHERE v IS NOT NULL),
 k AS (SELECT table_id, max(col_idx) + 1 AS width, bool_or(regexp_matches(lower(v), 'nfhs') AND row_idx = 0) AS headed FROM own GROUP BY ALL),
 w AS (SELECT table_id, col_idx, nullif(regexp_extract(lower(v), 'nfhs[\s-]*([0-9])', 1), '') AS wave FROM own WHERE row_idx = 0),
 gr AS (SELECT table_id, col_idx, 'nfhs' || coalesce(last_value(wave IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY col_idx), first_value(wave IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS grp FROM w),
 l AS (SELECT table_id, col_idx, lower(v) AS c, lag(lower(v)) OVER x AS before, lead(lower(v)) OVER x AS after FROM own WHERE row_idx = 2 WINDOW x AS (PARTITION BY table_id ORDER BY col_idx)),
 n AS (SELECT table_id, col_idx, CASE WHEN NOT headed THEN ['indicator', 'nfhs6_urban', 'nfhs6_rural', 'nfhs6_total', 'nfhs5_total'][col_idx + 1] WHEN col_idx = 0 THEN 'indicator'
    WHEN c LIKE 'urban%rural' THEN grp || CASE WHEN col_idx = 1 THEN '_urban' ELSE '_rural' END WHEN c = '' AND before LIKE 'urban%rural' AND col_idx = 2 THEN grp || '_rural' WHEN c = '' AND after LIKE 'urban%rural' AND col_idx > 0 THEN grp || '_urban'
    WHEN c = '' THEN 'col_' || col_idx ELSE grp || '_' || c END AS name FROM k JOIN l USING (table_id) LEFT JOIN gr USING (table_id, col_idx)),
 u AS (SELECT *, row_number() OVER (PARTITION BY table_id, name ORDER BY col_idx) - 1 AS again FROM n),
 f AS (SELECT table_id, col_idx, avg((v <> '')::INT) AS filled FROM own WHERE row_idx > 2 GROUP BY ALL)
 SELECT table_id, string_agg(name || CASE WHEN again > 0 THEN '_' || again ELSE '' END, '|' ORDER BY col_idx) AS names, any_value(CASE WHEN headed THEN 4 ELSE 5 END) AS n FROM u JOIN f USING (table_id, col_idx) JOIN k USING (table_id)
 WHERE col_idx < 5 OR (filled > 0.2 AND NOT name LIKE 'col_%') GROUP BY table_id""")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, D.SURVEYS)
    t = t.withColumn("rows", F.transform("rows", lambda r: F.filter(r, lambda v: v.isNotNull())))
    t = t.withColumn("h", F.when(F.col("table_id") % 5 == 3, 2).otherwise(3))
    return H.apply_headers(t).select("table_id", F.array_join("names", "|").alias("names"), F.size("rows").alias("n"))


RAW_NAMES = "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'S. No.' WHEN 1 THEN '2020-21' WHEN 2 THEN 'Number of xq Pumps ' || c_mktsegment WHEN 3 THEN 'nfhs6_urban' WHEN 4 THEN 'zz kk' ELSE 'Area 2019-20 Sown' END AS name FROM customer"


@query("h10_clean_column_name", f"WITH n AS ({RAW_NAMES}) SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 's_no' WHEN 1 THEN '2020_21' WHEN 2 THEN array_to_string(list_slice(list_filter(['number', 'pumps', lower(split_part(name, 'Pumps ', 2))], lambda x: length(regexp_replace(x, '[^aeiou]', '', 'g')) >= 0.25 * length(x) OR x = 'pumps'), 1, 4), '_') WHEN 3 THEN 'nfhs6_urban' WHEN 5 THEN 'area_sown_2019_20' END AS clean FROM n")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, RAW_NAMES).select("c_custkey", X.clean_column_name(F.col("name"), ("pumps",)).alias("clean"))


@query("h11_clean_headers", f"WITH g AS ({D.ROLES}) SELECT DISTINCT doc_id, table_id, 'code|s_no|month|state|year|percentage|date|label|value' AS names FROM g")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, D.ROLES).withColumn("names", F.array(*(F.lit(f"col_{k}") for k in range(9))))
    return H.clean_headers(t).select(*KEYS, F.array_join("names", "|").alias("names"))


SQL["h11_clean_headers"] = f"WITH g AS ({D.ROLES}) SELECT doc_id, table_id, 'code|s_no|month|state|year|percentage|date|label|value' AS names FROM g GROUP BY doc_id, table_id"


@query("h13_infer_role", f"WITH g AS ({D.ROLES}), t AS (SELECT doc_id, table_id FROM g GROUP BY ALL) SELECT doc_id, table_id, c AS col_idx, ['code', 's_no', 'month', 'state', 'year', 'percentage', 'date', 'name', NULL][c + 1] AS role FROM t CROSS JOIN (SELECT CAST(unnest(range(9)) AS INT) AS c)")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, D.ROLES)
    return t.select(*KEYS, F.posexplode(M.by_column(F.col("rows"), lambda v, i: N.role(v))).alias("col_idx", "role"))


DUPES = "SELECT c_custkey, c_custkey % 3 AS a, c_custkey % 2 AS b FROM customer"


@query("h12_dedupe_names", f"WITH n AS ({DUPES}) SELECT c_custkey, CASE a WHEN 0 THEN 'x|x_2|y|x_3' WHEN 1 THEN 'x|y|y_2|x_2' ELSE 'x|z|y|x_2' END AS names FROM n")
def _(spark, sf_dir):
    names = F.array(F.lit("x"), F.when(F.col("a") == 0, "x").when(F.col("a") == 1, "y").otherwise("z"), F.lit("y"), F.lit("x"))
    return D.query(spark, sf_dir, DUPES).select("c_custkey", F.array_join(N.dedupe_names(names), "|").alias("names"))


@query("h15_reference_names", f"WITH g AS ({D.ROLES}) SELECT doc_id, table_id, 'code|s_no|month|state|year|percentage|date|name|size' AS names FROM g GROUP BY doc_id, table_id")
def _(spark, sf_dir):
    names = F.array(*(F.lit(f"col_{k}") for k in range(8)), F.lit("size"))
    t = packed(spark, sf_dir, D.ROLES)
    return t.select(*KEYS, F.array_join(N.reference_names(F.col("rows"), names), "|").alias("names"))


CAPTIONS = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Table 3-2: Distribution of Orders' WHEN 1 THEN '4.1 Ranking of Urban Areas' WHEN 2 THEN 'Chapter-2C Orders by Priority and Status' WHEN 3 THEN 'this is a sentence. It ends.' ELSE '4. ryana Key Indicators' END AS caption FROM orders"


@query("h16_table_name", f"WITH c AS ({CAPTIONS}) SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Table 3.2 Distribution of Orders' WHEN 1 THEN '4.1 Ranking of Urban Areas' WHEN 2 THEN 'Orders Priority and Status' WHEN 4 THEN 'Haryana Key Indicators' END AS name FROM c")
def _(spark, sf_dir):
    rows = F.array(F.array(F.lit("1"), F.lit("2"))).cast("array<array<string>>")
    return D.query(spark, sf_dir, CAPTIONS).select("o_orderkey", N.table_name(rows, F.lit(1), F.col("caption")).alias("name"))


@query("h18_strong_title", "SELECT n_nationkey, n_nationkey % 3 < 2 AS strong, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS norm FROM nation")
def _(spark, sf_dir):
    n = D.query(spark, sf_dir, "SELECT * FROM nation")
    t = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("Annexure "), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("3.1 "), "n_name")).otherwise(F.col("n_name"))
    return n.select("n_nationkey", N.is_strong_title(t).alias("strong"), N.normal_name(F.col("n_name")).alias("norm"))


@query("h19_entity_variants", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_nationkey <> b.n_nationkey AS variant FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def _(spark, sf_dir):
    n = D.query(spark, sf_dir, "SELECT * FROM nation")
    title = lambda c: F.concat(F.replace(F.col(c), F.lit("_"), F.lit("")), F.lit(" Key Indicators"))
    return n.alias("a").join(n.alias("b"), "n_regionkey").select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), N.are_entity_variants(title("a.n_name"), title("b.n_name")).alias("variant"))


# -- stitching and catalogs -------------------------------------------------------------------------

def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = F.array(*map(F.lit, ("order_month", "gross_total", "net_share")))
    bare = F.array(*map(F.lit, ("col_0", "col_1", "col_2")))
    p = D.query(spark, sf_dir, D.PIECES)
    return p.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("table_id").cast("long").alias("table_id"), "page", "name", "n_rows", F.when(F.col("headless") == 1, bare).otherwise(real).alias("names"))


@query("r9_stitch_groups", f"WITH p AS ({D.PIECES}) SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(table_id % 100 >= 4 AS INT) AS group_id, max(name) FILTER (name LIKE 'Table%') AS name, string_agg(page, ',' ORDER BY page) AS pages, CAST(sum(n_rows) AS INT) AS n_rows FROM p GROUP BY ALL")
def _(spark, sf_dir):
    s = ST.stitched_items(pieces(spark, sf_dir))
    return s.select("doc_id", "group_id", "name", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "n_rows")


UNTITLED = "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS group_id, CASE WHEN c_custkey % 3 = 0 THEN 'Table of ' || c_mktsegment END AS name FROM customer"


@query("w6_inherit_titles", f"WITH g AS ({UNTITLED}), l AS (SELECT *, last_value(name IGNORE NULLS) OVER w AS t, last_value(CASE WHEN name IS NOT NULL THEN group_id END IGNORE NULLS) OVER w AS last_at FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY group_id)) SELECT doc_id, group_id, CASE WHEN name IS NULL AND group_id - last_at = 1 THEN t || ' (cont.)' ELSE name END AS name FROM l")
def _(spark, sf_dir):
    g = D.query(spark, sf_dir, UNTITLED).withColumn("pages", F.array("group_id")).withColumn("names", F.array(*map(F.lit, ("state", "total"))))
    return ST.inherit_titles(g).select("doc_id", "group_id", "name")


CAPS = "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS table_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS page, CASE WHEN c_custkey % 4 = 0 THEN 'Chapter 3 ' || c_mktsegment WHEN c_custkey % 4 = 1 THEN 'Table 1' ELSE '' END AS caption FROM customer"


@query("w5_carry_captions", f"WITH g AS ({CAPS}), l AS (SELECT *, last_value(CASE WHEN caption LIKE 'Chapter%' THEN caption END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN caption LIKE 'Chapter%' THEN page END IGNORE NULLS) OVER w AS p FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY page)) SELECT doc_id, table_id, page, CASE WHEN caption = '' AND page - p <= 5 THEN c ELSE caption END AS caption FROM l")
def _(spark, sf_dir):
    return ST.carry_captions(D.query(spark, sf_dir, CAPS))


FOUND = "SELECT CAST(o_custkey % 50 AS BIGINT) AS doc_id, o_orderkey AS table_id, CASE WHEN o_orderkey % 3 > 0 THEN 'Table ' || CAST(o_orderkey % 7 AS STRING) || '.1 ' || o_orderstatus || ' orders by ' || substr(o_orderpriority, 3) END AS name, CAST(o_orderkey % 90 + 1 AS INT) AS p, o_orderkey % 4 = 0 AS two FROM orders"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.query(spark, sf_dir, FOUND).withColumn("pages", F.when(F.col("two"), F.array("p", F.col("p") + 1)).otherwise(F.array("p")))
    rows = F.array_repeat(F.array(F.lit("a"), F.lit("b")), (F.col("table_id") % 5).cast("int"))
    return t.withColumn("names", F.array(F.lit("state"), F.lit("total"))).withColumn("rows", rows)


@query("k4_fallback_names", f"WITH f AS ({FOUND}), n AS (SELECT *, sum((name IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY p, table_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT doc_id, table_id, CASE WHEN name IS NULL THEN 'Table ' || CAST(k AS BIGINT) || ' (p.' || p || ')' WHEN two THEN name || ' (pp. ' || p || '–' || (p + 1) || ')' ELSE name END AS name FROM n")
def _(spark, sf_dir):
    return B.fallback_names(found(spark, sf_dir)).select("doc_id", "table_id", "name")


@query("k3_catalog", f"WITH f AS ({FOUND}) SELECT doc_id, table_id, name AS table_name, p AS page, CAST(table_id % 5 AS INT) AS rows, 2 AS columns, 'state|total' AS column_names FROM f")
def _(spark, sf_dir):
    return B.catalog(found(spark, sf_dir))


@query("k6_sheet_names", f"WITH f AS ({FOUND}), b AS (SELECT doc_id, table_id, substr(CASE WHEN name IS NULL THEN 'T' || table_id ELSE 'T' || table_id % 7 || '.1_orders_' || CASE WHEN name LIKE '%NOT SPEC%' THEN 'not_specified' ELSE lower(split_part(name, 'orders by ', 2)) END END, 1, 28) AS base FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY table_id) AS k FROM b) SELECT doc_id, table_id, CASE WHEN k > 1 THEN base || '_' || k ELSE base END AS sheet FROM r")
def _(spark, sf_dir):
    return B.sheet_names(found(spark, sf_dir)).select("doc_id", "table_id", "sheet")


@query("k10_catalog_search", f"WITH f AS ({FOUND}) SELECT doc_id, table_id, name AS table_name FROM f WHERE contains(lower(name), 'urgent') OR contains(CAST(table_id AS VARCHAR), 'URGENT')")
def _(spark, sf_dir):
    return B.search(B.catalog(found(spark, sf_dir)), "URGENT").select("doc_id", "table_id", "table_name")


PROMOTED = "SELECT CAST(c_nationkey AS BIGINT) AS t, CAST(c_custkey % 4 AS INT) AS page, c_mktsegment AS reason, c_custkey AS seq FROM customer"


@query("r11_promoted_upsert", f"WITH p AS ({PROMOTED}), r AS (SELECT *, row_number() OVER (PARTITION BY t, page ORDER BY seq % 2 DESC, seq DESC) AS k FROM p) SELECT t, page, reason, seq FROM r WHERE k = 1")
def _(spark, sf_dir):
    p = D.query(spark, sf_dir, PROMOTED)
    return B.upsert_promoted(p.filter("seq % 2 = 0"), p.filter("seq % 2 = 1"), "t", "page")


SET_ASIDE = "SELECT o_orderkey AS t, CAST(o_orderkey % 60 AS INT) AS page, 'prose_text' AS reason, 0.5 AS best_score, 'lattice' AS strategies_tried, CASE o_orderkey % 3 WHEN 0 THEN 'run9' WHEN 1 THEN 'run8' END AS last_rechecked FROM orders"


@query("j8_recheck", f"WITH s AS ({SET_ASIDE}) SELECT t AS table, page, CASE WHEN last_rechecked = 'run9' THEN reason ELSE 'merged_rows' END AS reason, coalesce(last_rechecked = 'run9', false) AS done FROM s WHERE coalesce(last_rechecked, '') = 'run9' OR t % 2 = 1")
def _(spark, sf_dir):
    q = D.query(spark, sf_dir, SET_ASIDE).withColumnRenamed("t", "table").withColumn("best_score", F.col("best_score").cast("double"))
    again = q.select("table", "page", F.when(F.col("table") % 2 == 0, "ok").otherwise("merged_rows").alias("reason"), F.lit(0.8).alias("score"))
    kept = B.recheck(q, again, "run9")[1]
    return kept.select("table", "page", "reason", (F.col("reason") == "prose_text").alias("done"))


SQL["j8_recheck"] = SQL["j8_recheck"].replace("AS table", 'AS "table"')


JOBS = "SELECT CAST(o_custkey % 30 AS BIGINT) AS doc_id, CASE WHEN o_orderkey % 5 > 0 THEN 'ok' END AS reason, CASE WHEN o_custkey % 30 = 7 THEN 'invalid_source:bot_redirect' ELSE 'ok' END AS source_status FROM orders"


@query("d13_job_status", f"WITH j AS ({JOBS}), n AS (SELECT doc_id, count(*) AS total, count(reason) AS progress, max(source_status) AS s FROM j GROUP BY ALL) SELECT doc_id, total, progress, CASE WHEN s LIKE 'invalid%' THEN 'invalid_source' WHEN progress = 0 THEN 'queued' WHEN progress < total THEN 'processing' ELSE 'done' END AS status FROM n")
def _(spark, sf_dir):
    return B.job_status(D.query(spark, sf_dir, JOBS))


# -- validation -------------------------------------------------------------------------------------

BROKEN = "SELECT CAST(c_custkey % 9 AS BIGINT) AS doc_id, c_custkey AS table_id, CAST(i AS INT) AS row_idx, CASE c_custkey % 9 WHEN 0 THEN 'Basic tables ........ 47' WHEN 1 THEN 'Shri Kumar' WHEN 2 THEN 'the survey was held in many rural areas of the state' WHEN 3 THEN '1' WHEN 4 THEN 'जिला' WHEN 5 THEN CASE WHEN i = 0 THEN 'x' ELSE '' END WHEN 6 THEN 'text' WHEN 7 THEN CASE WHEN i = 2 THEN '13 | P a g e' ELSE 'Area' END ELSE 'Area ' || CAST(i AS STRING) END AS c0, CASE c_custkey % 9 WHEN 0 THEN '12.5' WHEN 1 THEN 'Deputy Director' WHEN 2 THEN 'no number was given by these people in this year' WHEN 3 THEN '2' WHEN 4 THEN 'ftyk' WHEN 7 THEN '4.5' WHEN 8 THEN CASE WHEN c_custkey % 2 = 0 THEN '1.5 2.5 3.5 4.5' ELSE '1,200' END ELSE '' END AS c1, CASE c_custkey % 9 WHEN 3 THEN '(3)' WHEN 7 THEN '3' WHEN 8 THEN '7.5' ELSE '' END AS c2 FROM customer CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) q"
per_table("v_validate_reason", BROKEN, lambda r: [V.reason(r, F.array(*map(F.lit, ("name", "total", "rank")))).alias("reason")],
          f"WITH g AS ({BROKEN}) SELECT DISTINCT doc_id, table_id, CASE doc_id WHEN 0 THEN 'front_matter' WHEN 1 THEN 'front_matter' WHEN 2 THEN 'prose_text' WHEN 3 THEN 'index_legend_only' WHEN 4 THEN 'garbled_source' WHEN 5 THEN 'mostly_empty' WHEN 6 THEN 'single_column_list' WHEN 7 THEN 'page_footer_fragment' ELSE CASE WHEN table_id % 2 = 0 THEN 'merged_rows' ELSE 'ok' END END AS reason FROM g")


# -- words with places ------------------------------------------------------------------------------

EDGES_SQL = f"""w AS ({D.WORDS}), v AS (SELECT * FROM w WHERE regexp_matches(text, '^\\(?-?[0-9][0-9,]*(\\.[0-9]+)?%?\\)?$')), n AS (SELECT *, CASE WHEN x1 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x1) <= 12 THEN 0 ELSE 1 END AS new FROM v),
 r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY x1 RANGE UNBOUNDED PRECEDING) AS run FROM n), k AS (SELECT doc_id, page, run, avg(x1) AS anchor, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 3)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.query(spark, sf_dir, D.WORDS)
    return w.select(F.col("doc_id").cast("long").alias("doc_id"), "page", *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top")), "text")


@query("w10_right_edges", f"WITH {EDGES_SQL} SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INT) AS anchor_idx, CAST(anchor AS DOUBLE) AS anchor, n FROM k")
def _(spark, sf_dir):
    return G.right_edges(words(spark, sf_dir))


@query("s7_grid_from_words", f"""WITH {EDGES_SQL}, a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS i, CAST(anchor AS DOUBLE) AS anchor, count(*) OVER (PARTITION BY doc_id) AS of_page FROM k),
 t AS (SELECT *, row_number() OVER () AS id, regexp_matches(text, '^[0-9]{{3}}$') AS is_value FROM w),
 d AS (SELECT t.id, arg_min(a.i, abs(a.anchor - t.x1)) AS i, min(abs(a.anchor - t.x1)) AS off FROM t JOIN a USING (doc_id) WHERE of_page >= 2 GROUP BY t.id),
 o AS (SELECT t.*, d.i, is_value AND off <= 6 AS near, row_number() OVER (PARTITION BY t.doc_id, top, d.i, is_value AND off <= 6 ORDER BY x0, x1, text) AS nth FROM t JOIN d USING (id)),
 l AS (SELECT doc_id, page, top, row_number() OVER (PARTITION BY doc_id ORDER BY top) - 1 AS line, coalesce(string_agg(text, ' ' ORDER BY x0, x1, text) FILTER (NOT (near AND nth = 1)), '') AS label, count(*) FILTER (near) > 0 AS held FROM o GROUP BY doc_id, page, top),
 c AS (SELECT l.doc_id, l.page, l.line, a.i, coalesce(max(o.text), '') AS v FROM l JOIN a USING (doc_id) LEFT JOIN o ON o.doc_id = l.doc_id AND o.top = l.top AND o.i = a.i AND o.near AND o.nth = 1 GROUP BY ALL),
 x AS (SELECT doc_id, line, string_agg(v, '|' ORDER BY i) AS vals FROM c GROUP BY ALL),
 p AS (SELECT doc_id FROM l GROUP BY doc_id HAVING count(*) FILTER (held) >= 3)
 SELECT doc_id, page, CAST(line AS INT) AS row_idx, label || '|' || vals AS cells FROM l JOIN x USING (doc_id, line) JOIN p USING (doc_id)""")
def _(spark, sf_dir):
    g = G.grid_from_words(words(spark, sf_dir))
    return g.select("doc_id", "page", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("j3_bucket_words", f"WITH w AS ({D.WORDS}) SELECT doc_id, text, CAST(x0 AS DOUBLE) AS x0, CASE WHEN (x0 + x1) / 2 BETWEEN 0 AND 150 THEN 0 WHEN (x0 + x1) / 2 BETWEEN 140 AND 290 THEN 1 WHEN (x0 + x1) / 2 BETWEEN 280 AND 390 THEN 2 ELSE -1 END AS col_idx FROM w")
def _(spark, sf_dir):
    w = words(spark, sf_dir)
    c = w.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(F.array(*(F.struct(F.lit(k).alias("col_idx"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, lo, hi in ((0, 0.0, 150.0), (1, 140.0, 290.0), (2, 280.0, 390.0))))).alias("c")).select("doc_id", "page", "c.*")
    return G.bucket_words(w, c).select("doc_id", "text", "x0", F.coalesce("col_idx", F.lit(-1)).alias("col_idx"))


BOXES = "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(c_custkey % 5 AS INT) AS page, c_custkey AS id, CAST(c_custkey % 40 AS DOUBLE) * 10 AS top, CAST(c_custkey % 40 AS DOUBLE) * 10 + 20 + c_custkey % 50 AS bottom, CAST((c_custkey * 7) % 10 AS DOUBLE) / 10 AS score FROM customer"


@query("j5_best_overlap", f"WITH b AS ({BOXES}), c AS (SELECT * FROM b WHERE id % 3 = 0), p AS (SELECT b.id, c.id AS cand_id, c.score, row_number() OVER (PARTITION BY b.id ORDER BY c.score DESC, c.id) AS k FROM b JOIN c USING (doc_id, page) WHERE least(b.bottom, c.bottom) - greatest(b.top, c.top) > 0 AND least(b.bottom, c.bottom) - greatest(b.top, c.top) >= 0.3 * least(b.bottom - b.top, c.bottom - c.top)) SELECT b.id, coalesce(p.cand_id, -1) AS cand_id, coalesce(p.score, -1) AS score FROM b LEFT JOIN p ON b.id = p.id AND k = 1")
def _(spark, sf_dir):
    b = D.query(spark, sf_dir, BOXES)
    cand = b.filter("id % 3 = 0").select("doc_id", "page", F.col("id").alias("cand_id"), F.col("top").alias("c_top"), F.col("bottom").alias("c_bottom"), "score")
    return G.best_overlap(b.drop("score"), cand).select("id", F.coalesce("cand_id", F.lit(-1)).alias("cand_id"), F.coalesce("score", F.lit(-1.0)).alias("score"))


@query("w12_merge_split_values", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '12,345' ELSE '12|,345' END AS texts FROM orders")
def _(spark, sf_dir):
    o = D.query(spark, sf_dir, "SELECT o_orderkey FROM orders")
    gap = F.when(F.col("o_orderkey") % 3 == 0, 2.0).otherwise(9.0)
    toks = F.array(G.token(F.lit(10.0), F.lit(20.0), F.lit(5.0), F.lit("12")), G.token(20.0 + gap, 50.0 + gap, F.lit(6.0), F.lit(",345")))
    split = F.array_join(F.transform(G.merge_split(toks), lambda x: x["text"]), "|")
    return o.select("o_orderkey", split.alias("texts"))


@query("w11_text_lines", "WITH t AS (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS p, CAST(l_orderkey % 8 AS INT) AS l, count(*) AS n FROM lineitem GROUP BY ALL) SELECT p, count(*) AS lines, CAST(sum(n) AS BIGINT) AS words FROM t GROUP BY p")
def _(spark, sf_dir):
    w = D.query(spark, sf_dir, "SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS doc_id, 1 AS page, CAST(l_linenumber AS DOUBLE) AS x0, CAST(l_linenumber + 1 AS DOUBLE) AS x1, CAST(10 * (l_orderkey % 8) + l_partkey % 3 AS DOUBLE) AS top, 'w' AS text FROM lineitem")
    t = G.packed_tokens(w).withColumn("l", G.lines(F.col("toks")))
    return t.select(F.col("doc_id").alias("p"), F.size("l").cast("long").alias("lines"), F.size(F.flatten(F.transform("l", lambda x: x["toks"]))).cast("long").alias("words"))


# -- around a table ---------------------------------------------------------------------------------

LINES_SQL = "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(c_custkey % 50 AS INT) AS page, CAST(20 * (c_custkey % 7) AS DOUBLE) AS top, CASE c_custkey % 5 WHEN 0 THEN 'Table 2.1: Orders' WHEN 1 THEN 'of all nations' WHEN 2 THEN '3.1 Group of Nations' WHEN 3 THEN 'some words that are printed there.' ELSE 'Status of Orders' END AS text FROM customer"


@query("h17_captions", "SELECT n_nationkey AS table_id, CASE n_nationkey % 4 WHEN 0 THEN 'Table 2.1: Orders of all nations' WHEN 1 THEN '3.1 Group of Nations (part)' WHEN 2 THEN 'Status of Orders' ELSE 'some plain. words here.' END AS caption FROM nation")
def _(spark, sf_dir):
    n = D.query(spark, sf_dir, "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 1 AS page, n_nationkey AS table_id, 100.0D AS top, 300.0D AS bottom, 800.0D AS height FROM nation")
    k = F.col("table_id") % 4
    first = F.when(k == 0, "Table 2.1: Orders").when(k == 1, "3.1 Group of Nations").when(k == 2, "Status of Orders").otherwise("some plain.")
    second = F.when(k == 0, "of all nations").when(k == 1, "(part)").when(k == 2, "").otherwise("words here.")
    lines = n.select("doc_id", "page", F.explode(F.array(F.struct(F.lit(20.0).alias("top"), first.alias("text")), F.struct(F.lit(40.0).alias("top"), second.alias("text")), F.struct(F.lit(400.0).alias("top"), F.lit("Table 9: below").alias("text")))).alias("l")).select("doc_id", "page", "l.*")
    return L.captions(n, lines).select("table_id", "caption")


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = D.query(spark, sf_dir, "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 1 AS page, n_nationkey AS table_id, 100.0D AS top FROM nation")
    ranges = F.array(*(F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(lo + 90)).alias("hi")) for lo in (0, 100, 200)))
    said = F.array(*(F.struct(F.lit(y).alias("top"), F.lit(x).alias("x0"), F.lit(x + 30.0).alias("x1"), F.lit(w).alias("text")) for x, y, w in ((10.0, 80.0, "State"), (110.0, 80.0, "Rural"), (210.0, 80.0, "Urban"), (210.0, 90.0, "areas"), (10.0, 60.0, "Table"), (50.0, 60.0, "4"))))
    return n.withColumn("columns", ranges), n.select("doc_id", "page", F.explode(said).alias("w")).select("doc_id", "page", "w.*")


@query("p9_recover_headers", "SELECT n_nationkey AS table_id, CASE WHEN n_nationkey % 2 = 0 THEN 'State|Rural|Urban areas' ELSE 'Name|Rate|Share' END AS head FROM nation")
def _(spark, sf_dir):
    t, w = _placed(spark, sf_dir)
    body = F.array(F.lit("1"), F.lit("5"), F.lit("6"))
    rows = F.when(F.col("table_id") % 2 == 0, F.array(body, body)).otherwise(F.array(F.array(F.lit("Name"), F.lit("Rate"), F.lit("Share")), body))
    return L.recover_headers(t.withColumn("rows", rows), w).select("table_id", F.array_join(F.get("rows", F.lit(0)), "|").alias("head"))


@query("p8_repair_headers", "SELECT n_nationkey AS table_id, CASE WHEN n_nationkey % 2 = 0 THEN 'State|Rural|Urban areas' ELSE 'State|Rural|' END AS head FROM nation")
def _(spark, sf_dir):
    t, w = _placed(spark, sf_dir)
    rows = F.when(F.col("table_id") % 2 == 0, F.array(F.array(F.lit("State Urban areas Rural"), F.lit(""), F.lit("")))).otherwise(F.array(F.array(F.lit("State"), F.lit("Rural"), F.lit(""))))
    t = t.withColumn("rows", rows).withColumn("row_tops", F.array(F.lit(75.0), F.lit(95.0)))
    return L.repair_headers(t, w).select("table_id", F.array_join(F.get("rows", F.lit(0)), "|").alias("head"))


#: Words as a recogniser returns them, some unsure, some between or beside all ranges.
READ_WORDS = """SELECT CAST(floor(l_orderkey / 32) AS BIGINT) AS doc_id, 1 AS page, CAST(60 * (l_linenumber % 6) + l_partkey % 50 AS DOUBLE) AS x0, CAST(60 * (l_linenumber % 6) + l_partkey % 50 + 10 AS DOUBLE) AS x1,
 CAST(10 * (l_orderkey % 32) + l_suppkey % 10 AS DOUBLE) AS mid_y, CAST(l_partkey AS STRING) AS text, CAST(l_quantity * 2 AS DOUBLE) AS conf FROM lineitem"""
READ_COLUMNS, READ_ROWS = ((0.0, 100.0), (105.0, 200.0), (215.0, 300.0)), ((0.0, 90.0), (94.0, 200.0), (215.0, 300.0))


def _first_range(x: str, ranges: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {x} BETWEEN {lo} - 3 AND {hi} + 3 THEN {k}" for k, (lo, hi) in enumerate(ranges)) + " END"


@query("s9_recovered_cells", f"WITH w AS ({READ_WORDS}), p AS (SELECT *, CAST({_first_range('mid_y', READ_ROWS)} AS INT) AS row_idx, CAST({_first_range('(x0 + x1) / 2', READ_COLUMNS)} AS INT) AS col_idx FROM w WHERE conf >= 40) SELECT doc_id, row_idx, col_idx, string_agg(text, ' ' ORDER BY mid_y, x0, text) AS v FROM p WHERE row_idx IS NOT NULL AND col_idx IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    w = D.query(spark, sf_dir, READ_WORDS)
    pages = w.select("doc_id", "page").distinct()
    spans = lambda name, ranges: pages.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias(name), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in enumerate(ranges)))).alias("s")).select("doc_id", "page", "s.*")
    return G.recover_cells(w, spans("col_idx", READ_COLUMNS), spans("row_idx", READ_ROWS)).select("doc_id", "row_idx", "col_idx", "v")


# -- sources ----------------------------------------------------------------------------------------

@query("s2_magic_check", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ok' WHEN starts_with(lower(html), '<!doctype') OR contains(substr(lower(html), 1, 200), '<html') THEN 'invalid_source:bot_redirect' ELSE 'invalid_source' END AS status FROM pages")
def _(spark, sf_dir):
    p = D.query(spark, sf_dir, "SELECT page_id, html FROM pages")
    body = F.when(F.col("page_id") % 3 == 0, F.lit("%PDF-1.7")).otherwise(F.col("html")).cast("binary")
    return p.select("page_id", RD.source_status(body).alias("status"))


@query("s3_page_scope", "SELECT p_partkey, p_size FROM part WHERE p_size IN (3, 7, 8, 9)")
def _(spark, sf_dir):
    return RD.in_scope(D.query(spark, sf_dir, "SELECT * FROM part"), "3,7-9", "p_size").select("p_partkey", "p_size")


@query("s5_stream_gate", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 50 >= 80 AND l_discount * 800 <= CASE WHEN l_quantity + 50 >= 95 THEN 70 ELSE 60 END AND l_linenumber >= 4 AS keep FROM lineitem")
def _(spark, sf_dir):
    li = D.query(spark, sf_dir, "SELECT * FROM lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", RD.stream_gate(F.col("l_quantity") + 50, F.col("l_discount") * 800, F.col("l_linenumber"), F.lit(3)).alias("keep"))


@query("s11_scan_verdict", "WITH k AS (SELECT l_suppkey AS doc_id, CASE WHEN l_linenumber % 4 > 1 THEN 'text' WHEN l_quantity / 50 >= 0.8 THEN 'image' ELSE 'blank' END AS kind FROM lineitem), n AS (SELECT doc_id, count(*) AS pages_total, count(*) FILTER (kind = 'text') AS text, count(*) FILTER (kind = 'image') AS image, count(*) FILTER (kind = 'blank') AS blank FROM k GROUP BY ALL), f AS (SELECT *, CASE WHEN text + image > 0 THEN round(image / (text + image)::DOUBLE, 3) ELSE 0 END AS scanned_fraction FROM n) SELECT *, CASE WHEN text + image = 0 THEN 'empty' WHEN scanned_fraction >= 0.6 THEN 'scanned' WHEN scanned_fraction >= 0.15 THEN 'mixed' ELSE 'text' END AS verdict FROM f")
def _(spark, sf_dir):
    li = D.query(spark, sf_dir, "SELECT * FROM lineitem")
    kind = RD.page_kind(F.when(F.col("l_linenumber") % 4 > 1, 100).otherwise(0), F.col("l_quantity"), F.lit(50.0))
    return RD.scan_verdict(li.select(F.col("l_suppkey").alias("doc_id"), kind.alias("kind")))


@query("s13_page_batches", "SELECT CAST(l_suppkey AS BIGINT) AS doc_id, CAST(floor((l_linenumber * 9 - 1) / 25) AS INT) AS batch, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    li = D.query(spark, sf_dir, "SELECT * FROM lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_linenumber") * 9).alias("page"))
    return RD.page_batches(li).groupBy("doc_id", "batch").agg(F.count("*").alias("n"))


# -- text -------------------------------------------------------------------------------------------

TOKENS = "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'ftyk' WHEN 1 THEN p_type WHEN 2 THEN 'Non-Tax' WHEN 3 THEN 'banks' WHEN 4 THEN 'ys[ks' WHEN 5 THEN 'MinistriesDepartments' WHEN 6 THEN 'bUnkSj' ELSE 'xy' END AS t FROM part"


@query("f4_looks_soup", r"""SELECT p_partkey, CASE WHEN p_partkey % 8 = 1 THEN length(b) >= 3 AND NOT regexp_full_match(b, '[A-Z][a-z]+|[A-Z]+') ELSE p_partkey % 8 IN (0, 4, 6) END AS soup FROM (SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z]', '', 'g') AS b FROM part)""")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, TOKENS).select("p_partkey", X.looks_soup(F.col("t")).alias("soup"))


@query("f5_soup_to_unicode", "SELECT n_nationkey, ['जिला', 'कुल', 'योग'][1 + n_nationkey % 3] AS dev FROM nation")
def _(spark, sf_dir):
    n = D.query(spark, sf_dir, "SELECT n_nationkey FROM nation")
    t = F.when(F.col("n_nationkey") % 3 == 0, "ftyk").when(F.col("n_nationkey") % 3 == 1, "dqy").otherwise(";ksx")
    return n.select("n_nationkey", X.soup_to_unicode(t).alias("dev"))


@query("f6_unicode_to_ascii", "SELECT n_nationkey, 'Total' AS ascii FROM nation")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, "SELECT n_nationkey FROM nation").select("n_nationkey", X.unicode_to_ascii(F.lit("ज्वजंस")).alias("ascii"))


@query("f7_transliterate", "SELECT n_nationkey, 'jilaa ' || n_name || ' 2' AS latin FROM nation")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, "SELECT * FROM nation").select("n_nationkey", X.transliterate(F.concat(F.lit("जिला "), "n_name", F.lit(" २"))).alias("latin"))


@query("f8_translate", "SELECT n_nationkey, ['Revenue Receipts', 'District', 'Total ' || n_name, 'Plain Text', 'Yoga'][1 + n_nationkey % 5] AS english FROM nation")
def _(spark, sf_dir):
    k = F.col("n_nationkey") % 5
    t = F.when(k == 0, "jktLo izkfIr;ka Revenue Receipts").when(k == 1, "जिला").when(k == 2, F.concat(F.lit("कुल "), "n_name")).when(k == 3, "Plain Text").otherwise("यो ग")
    return D.query(spark, sf_dir, "SELECT * FROM nation").select("n_nationkey", X.translate(t, [("कुल", "Total")], [("जिला", "District")], [("योग", "Yoga")]).alias("english"))


_NAMED = (*X.STATES, *X.STATE_FRAGMENTS)
#: Every state, whole and without up to four of its first letters, and the known fragments, before three endings.
CUT_STATES = f"""SELECT p_partkey, substr(CASE p_partkey % {len(_NAMED)} {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NAMED))} END, 1 + CAST(floor(p_partkey / {len(_NAMED)}) AS INT) % 5)
 || CASE p_partkey % 4 WHEN 0 THEN ' Key Indicators' WHEN 1 THEN ' key indicators' WHEN 2 THEN ' Indicators' ELSE ' Report' END AS t FROM part"""


@query("f11_repair_state", f"""WITH n AS ({CUT_STATES}), l AS (SELECT *, trim(lower(regexp_replace(t, '(?i)( key)? indicators$', ''))) AS low, [{', '.join(f"'{x}'" for x in X.STATES)}] AS states FROM n),
 f AS (SELECT *, CASE low {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in X.STATE_FRAGMENTS.items())} ELSE list_filter(states, lambda x: ends_with(lower(x), low) AND length(low) >= 3)[1] END AS whole FROM l)
 SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 OR whole IS NULL OR list_contains(list_transform(states, lambda x: lower(x)), low) THEN t ELSE whole || ' Key Indicators' END AS name FROM f""")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, CUT_STATES).select("p_partkey", X.repair_state(F.col("t")).alias("name"))


@query("f13_slug_and_eta", "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 42) AS slug, CAST(floor(p_size * 37 / 60) AS INT) || 'm ' || lpad(CAST(p_size * 37 % 60 AS VARCHAR), 2, '0') || 's' AS eta FROM part")
def _(spark, sf_dir):
    p = D.query(spark, sf_dir, "SELECT * FROM part")
    return p.select("p_partkey", X.slug(F.concat("p_type", F.lit(" / "), "p_brand")).alias("slug"), X.eta(F.col("p_size") * 37).alias("eta"))


@query("f9_decode_mojibake", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Total' ELSE n_name END AS t FROM nation")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, "SELECT * FROM nation").select("n_nationkey", X.decode_mojibake(F.when(F.col("n_nationkey") % 2 == 0, "ज्वजंस").otherwise(F.col("n_name"))).alias("t"))


@query("f10_translated_cells", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'House' ELSE c_mktsegment END AS v FROM customer")
def _(spark, sf_dir):
    c = D.query(spark, sf_dir, "SELECT c_custkey, c_mktsegment AS v FROM customer")
    return B.translated_cells(c, lambda v: X.translate(v, [], exact=[("BUILDING", "House")])).select("c_custkey", "v")


@query("j1_lexicon_lookup", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'exact' WHEN 'MACHINERY' THEN 'loose' END AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark, sf_dir):
    c = D.query(spark, sf_dir, "SELECT c_custkey, c_mktsegment AS label FROM customer")
    lexicon = spark.createDataFrame([("BUILDING", "exact", 0), ("building", "late", 1), ("Machi nery", "loose", 2)], "key string, value string, ord int")
    return B.looked_up(c, lexicon).filter("value is not null").select("c_custkey", "value")


@query("a15_stress_summary", f"WITH v AS ({CHECKED}), n AS (SELECT doc_id, count(*) AS found, count(*) FILTER (reason = 'ok') AS passed, CAST(sum(page % 3) AS BIGINT) AS orphans, count(*) FILTER (reason = 'ok' AND page % 2 = 0) AS after_stitch FROM v GROUP BY ALL) SELECT doc_id, found, passed, after_stitch, passed - after_stitch AS merges, orphans FROM n")
def _(spark, sf_dir):
    v = D.query(spark, sf_dir, CHECKED).withColumn("orphan_rows", F.col("page") % 3)
    return B.stress_summary(v, v.filter("reason = 'ok' and page % 2 = 0"))


@query("h14_confident_role", f"WITH g AS ({D.ROLES}), t AS (SELECT doc_id, table_id FROM g GROUP BY ALL) SELECT doc_id, table_id, c AS col_idx, ['code', 's_no', 'month', 'state', 'year', 'percentage', 'date', '-', '-'][c + 1] AS role FROM t CROSS JOIN (SELECT CAST(unnest(range(9)) AS INT) AS c)")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, D.ROLES)
    return t.select(*KEYS, F.posexplode(M.by_column(F.col("rows"), lambda v, i: F.coalesce(N.confident_role(v), F.lit("-")))).alias("col_idx", "role"))


@query("h4_english_words", "SELECT n_nationkey, ['Number of Hand Pumps', 'GDP rural', 'Total', ''][n_nationkey % 4 + 1] AS e FROM nation")
def _(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    t = F.when(k == 0, "Number of gSaMiaiksa Hand Pumps").when(k == 1, "GDP rural tqx").when(k == 2, "Total (12)").otherwise("dh gtkj")
    return D.query(spark, sf_dir, "SELECT n_nationkey FROM nation").select("n_nationkey", H.english(t).alias("e"))


@query("h8_reference_headers", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'nco_2015_code|title' ELSE 'col_0|col_1' END AS names FROM nation")
def _(spark, sf_dir):
    rows = F.array(F.array(F.lit("NCO 2015"), F.lit("Title")), F.array(F.lit("Code"), F.lit("")), F.array(F.lit("1111.0100"), F.lit("Manager")))
    return D.query(spark, sf_dir, "SELECT n_nationkey FROM nation").select("n_nationkey", F.array_join(H.reference_band_names(rows, F.when(F.col("n_nationkey") % 2 == 0, 2).otherwise(0)), "|").alias("names"))


@query("w8_serial_run", f"WITH g AS ({D.ROLES}), t AS (SELECT doc_id, table_id FROM g GROUP BY ALL) SELECT doc_id, table_id, c AS col_idx, c = 1 AS serial FROM t CROSS JOIN (SELECT CAST(unnest(range(9)) AS INT) AS c)")
def _(spark, sf_dir):
    t = packed(spark, sf_dir, D.ROLES)
    return t.select(*KEYS, F.posexplode(M.by_column(F.col("rows"), lambda v, i: F.coalesce(N.is_serial_run(R.non_empty(v)), F.lit(False)))).alias("col_idx", "serial"))


#: Four names in every combination of a wave with and without a part, a part alone, and neither.
WAVES = "SELECT 0 AS doc_id, p_partkey AS table_id, 0 AS row_idx, " + ", ".join(
    f"CASE CAST(floor(p_partkey / {5**k}) AS INT) % 5 WHEN 0 THEN 'NFHS-' || CAST((p_partkey + {k}) % 6 + 1 AS STRING) || ' Urban' WHEN 1 THEN 'Rural' WHEN 2 THEN 'TOTAL' WHEN 3 THEN 'Area' ELSE 'nfhs ' || CAST((p_partkey + {k}) % 4 + 2 AS STRING) END AS c{k}" for k in range(4)
) + " FROM part"


@query("s10_grouped_names", f"""WITH {D.long(WAVES, 4)}, w AS (SELECT table_id, col_idx, v, nullif(regexp_extract(lower(v), 'nfhs[- ]([0-9])', 1), '') AS wave, CASE WHEN contains(lower(v), 'urban') THEN '_urban' WHEN lower(v) IN ('rural', 'total') THEN '_' || lower(v) ELSE '' END AS part FROM cells),
 l AS (SELECT *, last_value(wave IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY col_idx) AS now, count(wave) OVER (PARTITION BY table_id) AS waves FROM w)
 SELECT table_id, string_agg(CASE WHEN waves = 0 THEN v WHEN col_idx = 0 THEN 'indicator' WHEN now IS NULL THEN v ELSE 'nfhs' || now || part END, '|' ORDER BY col_idx) AS names FROM l GROUP BY table_id""")
def _(spark, sf_dir):
    return D.query(spark, sf_dir, WAVES).select("table_id", F.array_join(RD.rename_grouped(F.array("c0", "c1", "c2", "c3")), "|").alias("names"))


@query("s9b_lower_corruption", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 5 >= 0.3::DOUBLE AND l_returnflag <> 'A' AND l_tax * 6 < l_discount * 5 THEN 'again' ELSE 'first' END AS pick FROM lineitem")
def _(spark, sf_dir):
    score = lambda x, d: F.struct(x.alias("score"), d.alias("dominant"))
    before = score(F.col("l_discount") * 5, F.when(F.col("l_returnflag") == "A", "deva").otherwise("kruti"))
    pick = RD.pick_lower_corruption(before, score(F.col("l_tax") * 6, F.lit("kruti")), F.lit("first"), F.lit("again"))
    return D.query(spark, sf_dir, "SELECT * FROM lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pick.alias("pick"))


# -- the whole chain --------------------------------------------------------------------------------

CENSUS = """SELECT n_regionkey AS doc_id, rn AS table_id, CAST(row_number() OVER (PARTITION BY n_regionkey, rn ORDER BY ord) - 1 AS INT) AS row_idx, c0, c1, c2 FROM (
 SELECT r_regionkey AS n_regionkey, s AS rn, 0 AS ord, 'Nation' AS c0, 'Customers 2020' AS c1, 'Balance 2021' AS c2 FROM region CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2) q
 UNION ALL SELECT n_regionkey, 1 + n_nationkey % 2, 10 + n_nationkey * 2, n_name, CAST(cnt AS STRING), bal FROM nation JOIN (SELECT c_nationkey, count(*) AS cnt,
   CASE WHEN sum(CAST(floor(c_acctbal) AS BIGINT)) < 0 THEN '(' || CAST(-sum(CAST(floor(c_acctbal) AS BIGINT)) AS STRING) || ')' ELSE CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS STRING) END AS bal FROM customer GROUP BY c_nationkey) c ON c_nationkey = n_nationkey) t"""


def chain(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from gridloom.plans import pipeline as P

    g = D.grid(spark, sf_dir, CENSUS).withColumn("page", (F.col("table_id") * 9).cast("int")).withColumn("caption", F.concat(F.lit("Table 1."), F.col("table_id").cast("string"), F.lit(" Customers of nations")))
    return P.run(M.pack(g.withColumn("doc_id", F.col("doc_id").cast("long")), "page", "caption"))


@query("pipeline_catalog", f"WITH g AS ({CENSUS}) SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(table_id AS BIGINT) AS table_id, 'Table 1.' || table_id || ' Customers of nations' AS table_name, CAST(table_id * 9 AS INT) AS page, CAST(count(*) - 1 AS INT) AS rows, 3 AS columns, 'nation|customers|balance' AS column_names FROM g GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf_dir):
    return chain(spark, sf_dir)["catalog"]


@query("pipeline_cells", f"WITH g AS ({CENSUS}), l AS (SELECT doc_id, table_id, row_idx - 1 AS row_idx, 0 AS col_idx, c0 AS v FROM g UNION ALL SELECT doc_id, table_id, row_idx - 1, 1, c1 FROM g UNION ALL SELECT doc_id, table_id, row_idx - 1, 2, c2 FROM g) SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(table_id AS BIGINT) AS table_id, CAST(row_idx AS INT) AS row_idx, CAST(col_idx AS INT) AS col_idx, v, CASE WHEN col_idx > 0 THEN CAST(replace(replace(v, '(', '-'), ')', '') AS DOUBLE) END AS num FROM l WHERE row_idx >= 0")
def _(spark, sf_dir):
    return chain(spark, sf_dir)["cells"].select(*KEYS, "row_idx", "col_idx", "v", "num")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir)["cells"]
