"""Corpus pipeline over ``documents``: clean, deduplicate, mix and pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``docs``.

Rows are told apart by id and text together, so ids may be null or shared, and a decision about one
row never touches another. All stages give an empty result for an empty table and keep further columns as
they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard_join, mixture, packing, suffix_dedup, toxicity
from gridloom.llm.common import Cuts, broadcast_if_small, small_batches, table


#: What counts as a repeated passage: so many words in a row, found by anchors of so many.
PASSAGE_WORDS, ANCHOR_WORDS = 51, 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; trained on all labels. Null and empty texts stay
    (they have no hits), repeated rows share their fate, a null id only lacks a label."""
    small_batches(spark)
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("t"))
    return toxicity.toxicity(rows, lexicon, id_col="row", text_col="t").filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays (null ids last, then the smallest hash of
    id and text), so reruns agree. Rows equal in id and text become one; null and empty texts are near to nothing."""
    small_batches(spark)
    cuts = Cuts(spark)
    name = F.col("doc_id").cast("string")
    own = [F.isnull(name), name, F.isnull("text"), F.col("text")]  # xxhash64 passes over nulls
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*own).alias("k1"), F.xxhash64(*reversed(own)).alias("k2"))
    groups = cuts.write(jaccard_join.jaccard_groups(rows.select("k1", F.col("row.text").alias("text")), id_col="k1"))
    order = F.struct(F.col("row.doc_id").isNull().alias("last"), F.col("row.doc_id").alias("doc_id"), "k1")
    places = cuts.write(rows.groupBy("k1").agg(F.min(order).alias("place"), F.count("*").alias("n")))
    many = groups.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1")
    members = groups.join(many, "component_id").select("k1", "component_id").join(places.select("k1", "place"), "k1")
    first = members.groupBy("component_id").agg(F.min("place").alias("first"))
    goes = members.join(first, "component_id").filter("k1 <> first.k1").select("k1", F.lit(False).alias("stays"))
    repeated = places.filter("n > 1").join(goes, "k1", "left_anti").select("k1", F.lit(True).alias("stays"))
    touched = cuts.write(goes.union(repeated))  # all other rows stay where they are, no text is shuffled for them
    n, again = touched.agg(F.count("*"), F.count_if("stays")).first()
    kept = rows.join(broadcast_if_small(touched.select("k1"), n, 40), "k1", "left_anti").select("row.*")
    if not again:
        return kept
    once = rows.join(broadcast_if_small(touched.filter("stays").select("k1"), again, 40), "k1", "left_semi").dropDuplicates(["k1", "k2"])
    return kept.union(once.select("row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that stand anywhere else too, all occurrences of them; untouched texts
    stay as they are, null ones too. A text may become empty; its row stays."""
    made = suffix_dedup.without_repeats(docs, PASSAGE_WORDS, ANCHOR_WORDS, words=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return made.select(*({"text": text, "n_chars": n_chars}.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; what has no words has nothing to give and goes. A null source is one of its own."""
    made = mixture.mix(docs).filter("taken > 0")
    return made.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; few words are kept, as the workers hold what earlier stages keep. Null and empty texts have
    their end id only."""
    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), words_kept=50_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]

#: Learned scores, suffix arrays and tokenizers have no SQL form; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = Cuts(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cuts.write(docs)
    return docs
