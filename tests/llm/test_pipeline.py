"""The pipeline's stages one after another, held against plain Python on the smallest documents."""

import os
import random
import sys
import time
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline as CP
from gridloom.llm import token_counts
from gridloom.llm.common import Cuts, shared_dir
from tests.llm.test_llm import brute_groups, brute_words, prose

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, cuts, seen = docs.columns, Cuts(spark), [docs]
    for _, stage in CP.STAGES:
        seen.append(cuts.write(stage(spark, seen[-1], SF)))
        if stage is not CP.pack_windows:
            assert seen[-1].columns == columns
    rows = [[r.asDict() for r in d.collect()] for d in seen]
    text = [{r["doc_id"]: r["text"] for r in part} for part in rows[:4]]
    assert 0.7 * len(rows[0]) < len(rows[1]) < len(rows[0])
    groups = brute_groups(sorted(text[1].items()))
    assert set(text[2]) == {i for i, (_, c) in groups.items() if c == i}
    ids = sorted(text[2])
    assert [text[3][i] for i in ids] == brute_words([text[2][i] for i in ids], 51) and any(text[3][i] != text[2][i] for i in ids)
    copies = Counter(r["doc_id"] for r in rows[4])
    assert all(r["n_chars"] == len(r["text"]) for r in rows[3] if r["text"] != text[2][r["doc_id"]])
    assert set(copies) <= set(text[3]) and max(copies.values()) <= 2
    t = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
    packed = Counter()
    for r in rows[5]:
        packed[r["doc_id"]] += r["length"]
    assert all(packed[i] == n * (len(t.encode(text[3][i] or "", add_special_tokens=False).ids) + 1) for i, n in copies.items())


def test_run_gives_the_last_stage(spark):
    assert CP.run(spark, SF).columns[:3] == ["doc_id", "start", "length"]
    assert len(CP.STAGES) == 5 and np.unique([n for n, _ in CP.STAGES]).size == 5 and "corpus_pipeline" in sys.modules


def odd_documents(spark):
    """Null and shared ids, null and empty texts, repeated rows, near copies, planted passages, clashing columns."""
    rng = random.Random(41)
    base, passages = prose(rng, 200), [prose(rng, n) for n in (51, 60, 70)]
    rows = [(k, prose(rng, 150) + (" " + passages[k % 3] + " " + prose(rng, 20) if k < 30 else "")) for k in range(60)]
    rows += [(None, base), (None, prose(rng, 90)), (None, prose(rng, 90)), (100, base), (100, prose(rng, 80)), (101, base.replace(base.split()[50], "else")), (102, None), (102, None), (103, ""), (None, None), (None, "")]
    rows += [(200, prose(rng, 70))] * 3 + [(None, rows[-1][1] if rows[-1][1] else prose(rng, 30))] * 2
    ddl = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, key string, k1 long, source_size long, h long"
    return rows, passages, spark.createDataFrame([(i, t, "en", "ab"[k % 2] if k % 5 else None, None if t is None else len(t), "r", 1, "k", 2, 3, 4) for k, (i, t) in enumerate(rows)], ddl)


def test_stages_on_odd_rows(spark):
    rows, passages, docs = odd_documents(spark)
    at, cuts = docs, Cuts(spark)
    seen = []
    for _, stage in CP.STAGES[:-1]:
        at = cuts.write(stage(spark, at, SF))
        assert at.columns == docs.columns
        seen.append([(r["doc_id"], r["text"]) for r in at.collect()])
    toxic, near, cut, mixed = seen
    order = lambda x: repr(x)
    distinct = sorted(set(toxic), key=order)
    groups = brute_groups([(k, t) for k, (_, t) in enumerate(distinct)])
    first = {}
    for k, (_, c) in groups.items():
        first.setdefault(c, []).append(distinct[k])
    assert len(near) == len(first) and all(len([x for x in near if x in own]) == 1 for own in first.values())
    for own in first.values():  # the smallest id of each group
        ids = [i for i, _ in own if i is not None]
        assert [i for i, t in near if (i, t) in own] == [min(ids) if ids else None]
    texts = [t for _, t in near]
    assert sorted((repr(i), t or "") for i, t in cut) == sorted((repr(i), t) for (i, _), t in zip(near, brute_words(texts, 51)))
    assert not any(p[20:-20] in (t or "") for p in passages for _, t in cut) and sum(any(p in (t or "") for p in passages) for _, t in near) > 20
    clean = {x for x in near if not any(p in (x[1] or "") for p in passages)}
    assert clean <= set(cut)
    assert set(mixed) <= set(cut) and max(Counter(mixed).values()) <= 2 and all(t for _, t in mixed)
    packed = CP.pack_windows(spark, at, SF).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in mixed}


def test_stages_on_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in CP.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_near_duplicates_of_shared_phrases_are_small_islands(spark, monkeypatch):
    """The stage joins near copies by themselves, although a rare phrase leads from each pair to the next."""
    from gridloom.llm import jaccard_join

    words = lambda k, side: [f"w{k}x{j}" for j in range(40)] + [f"phrase{side}", "of", "some", "five", "words"] + [f"w{k}y{j}" for j in range(55)]
    rows = [(2 * k + side, " ".join(words(k, k + side)), "en", "s", 1) for k in range(12) for side in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen, join = [], jaccard_join.metric_join
    monkeypatch.setattr(jaccard_join, "metric_join", lambda cuts, regions, *rest: (seen.extend(r["count"] for r in regions.groupBy("region").count().collect()), join(cuts, regions, *rest))[1])
    kept = CP.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 24, 2)) and seen == [2] * 12


def test_cuts_leave_no_shuffle_files(spark):
    def shuffled():
        return {f.getName() for f in list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())) if f.getName().startswith("shuffle_")}

    before, conf = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    made = Cuts(spark).write(spark.range(5000).selectExpr("id % 700 AS k").groupBy("k").count().repartition(3, "count"))
    ends = time.time() + 20
    while shuffled() - before and time.time() < ends:  # they go in the background
        time.sleep(0.2)
    assert not shuffled() - before and made.count() == 700 and spark.conf.get(conf, None) is None


def test_near_duplicates_leave_texts_and_disk_alone(spark):
    """Rows that stay aren't shuffled; what the search for links wrote is gone when the stage has its groups."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = CP.drop_near_duplicates(spark, docs, SF)
    tables = [spark.read.parquet(f"{folder}/{d}/{k}") for d in set(os.listdir(folder)) - before for k in os.listdir(f"{folder}/{d}")]
    assert len(tables) > 3 and not any({"set", "data", "bits", "h"} & set(t.columns) for t in tables)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString() and 0 < got.count() < docs.count()
