"""The registered queries opN_<name> and their SQL, each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.vector_links import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixture import mix

    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("row.doc_id", "size", "source_size", "target", "taken")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.url_rules import url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op7_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.sketches import fingerprints

    return fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.language_id import languages, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(_fold("doc_id", 4) != 2))
    return languages(docs, model).withColumn("held_out", F.coalesce(_fold("doc_id", 4) == 2, F.lit(False)))


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(_fold("doc_id", 3) != 1)
    return toxicity(docs, train(docs, labels)).withColumn("held_out", F.coalesce(_fold("doc_id", 3) == 1, F.lit(False)))


def _fold(column: str, n: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_vector_links, op4_packing, op5_source_mix, op6_url_rules, op7_sketches, op8_language_id, op9_jaccard_groups, op10_toxicity)}

SQL: dict[str, str] = {}

SQL["op5_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
e AS (SELECT *, (CAST(('0x' || substr(key, 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u, CAST(floor(100 * sqrt(size)) AS BIGINT) AS w FROM d),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM t),
v AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[1 + (place - 1) % 3] AS weight FROM r),
f AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM v),
g AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM f),
c AS (SELECT *, (1.5::DOUBLE * total - capped) / open_w AS c FROM g),
l AS (SELECT c AS level FROM c WHERE c <= full_at ORDER BY full_at, place LIMIT 1),
p AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM l), 0) * weight) AS target FROM c),
m AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS certain FROM p),
o AS (SELECT *, target - certain * source_size AS open FROM m),
h AS (SELECT source, size, w, count(*) AS n FROM e WHERE size > 0 GROUP BY source, size, w),
i AS (SELECT h.*, o.open,
        CAST(coalesce(sum(n * size) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS above,
        CAST(sum(n * size * w) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS mass
      FROM h JOIN o ON h.source IS NOT DISTINCT FROM o.source WHERE o.open > 0),
j AS (SELECT *, (open - above) / mass::DOUBLE AS k FROM i),
b AS (SELECT source, max(size) AS top, arg_max(k, size) AS k, arg_max(open - above, size) AS rest FROM j WHERE k * w <= 1 GROUP BY source),
x AS (SELECT e.*, o.source_size, o.target, o.certain, b.top, b.rest,
        CASE WHEN e.size > 0 AND e.size <= b.top THEN u / (1 - u) * (1 - b.k * w) / (b.k * w) END AS q
      FROM e JOIN o ON e.source IS NOT DISTINCT FROM o.source LEFT JOIN b ON e.source IS NOT DISTINCT FROM b.source),
y AS (SELECT *, sum(size) OVER (PARTITION BY source, q, key) AS own,
        sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM x)
SELECT doc_id, size, source_size, target,
       CAST(size * (certain + CASE WHEN size > top OR (q IS NOT NULL AND so_far - own + own / 2.0::DOUBLE <= rest) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM y
"""

SQL["op6_url_rules"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '') AS host0, coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path FROM u),
p AS (SELECT page_id, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, row_number() OVER () AS rn FROM h),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT rn, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rn)
"""
