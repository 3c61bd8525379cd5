"""Each operator against brute force on small tables, and its defined results for odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import jaccard_join, language_id, mixture, packing, queries, sketches, suffix_dedup, token_counts, toxicity, unions, url_rules, vector_links
from gridloom.llm.common import Cuts, components

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, row string, t string, id long, h long, n int, size long"


def prose(rng, words):
    return " ".join(rng.choice(VOCABULARY) for _ in range(words)) + "."


VOCABULARY = ["".join(random.Random(k).choices("abcdefghinorstu", k=5)) for k in range(400)]


@pytest.fixture(scope="module")
def odd():
    """Null, empty, blank, repeated, long, near and exact copies, null ids."""
    rng = random.Random(5)
    base, long = prose(rng, 120), prose(rng, 4000)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (7, "one two"), (None, base), (None, None), (8, long), (9, "é " * 300), (10, prose(rng, 80) + "\n" + base[:450])]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", 99, 98, 97, 96) for i, t in texts], DDL)


def words(text):
    return [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


# -- 1 ----------------------------------------------------------------------------------------------


def brute_repeats(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + 400] for r in raws for k in range(len(r) - 399))
    out = []
    for r in raws:
        cut = [False] * len(r)
        for k in range(len(r) - 399):
            if seen[r[k : k + 400]] > 1:
                cut[k : k + 400] = [True] * 400
        kept = bytes(b for b, c in zip(r, cut) if not c)
        out.append((len(r), sum(cut), sum(c and not (k and cut[k - 1]) for k, c in enumerate(cut)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(spark, odd, hot):
    got = suffix_dedup.without_repeats(frame(spark, odd), hot=hot).select("row.doc_id", "row.text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "row.row").collect()
    want = sorted(map(repr, zip([i for i, _ in odd], brute_repeats([t for _, t in odd]))))
    assert sorted(repr((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))) for r in got) == want
    assert any(r["n_removed"] for r in got) and all(r["row"] == "x" for r in got)


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_at_borders_of_pieces(spark, hot):
    """Passages that start or end about every border of a text that is read in pieces."""
    rng = random.Random(21)
    piece, step = 1500, 1500 - 400 + 1
    long = prose(rng, 1800)
    borders = range(step, len(long) - 1000, step)
    texts = [(0, long)]
    for k, b in enumerate(borders):
        cuts = [(b - rng.randrange(1, 300), 400 + rng.randrange(0, 300)), (b + rng.randrange(0, 400) - 600, 600)]
        texts += [(10 * k + j + 1, prose(rng, 8) + long[s : s + n] + prose(rng, 8)) for j, (s, n) in enumerate(cuts) if (k + j) % 2]
    got = suffix_dedup.without_repeats(frame(spark, texts), hot=hot, piece=piece).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = sorted(map(repr, zip([i for i, _ in texts], brute_repeats([t for _, t in texts]))))
    assert len(borders) > 6 and sorted(repr((r["doc_id"], tuple(r)[1:])) for r in got) == want


def test_huge_text_beside_empty_ones():
    """Anchors are those of one go, and no more than a piece is looked at together."""
    text = prose(random.Random(22), 1800)
    rows = [(1, 1, ""), (2, 2, None), (3, 3, text), (4, 4, ""), (5, 5, text[:900])]
    batch = suffix_dedup.pa.RecordBatch.from_arrays([suffix_dedup.pa.array(c) for c in zip(*rows)], names=["r1", "r2", "t"])
    seen, anchors = [], suffix_dedup.anchors
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix_dedup, "anchors", lambda data, *rest: seen.append(len(data)) or anchors(data, *rest))
        got = [r for b in suffix_dedup._anchor_rows([batch], piece=1500) for r in b.to_pylist()]
    whole = [r for b in suffix_dedup._anchor_rows([batch]) for r in b.to_pylist()]
    windows = lambda rs: sorted((r["h"], r["r1"], r["r2"], r["pos"], o) for r in rs for o in range(r["lo"], r["hi"] + 1))
    assert windows(got) == windows(whole) and max(seen) <= 2 * 1500


def test_equal_rows_without_ids(spark):
    """Many equal rows: each keeps nothing of what they share, and their intervals stay one text's."""
    rng = random.Random(24)
    text, other = prose(rng, 150), prose(rng, 90)
    rows = [(None, text)] * 3000 + [(None, prose(rng, 9) + text[:500] + other), (4, other + "x" + text[-450:])]
    out = suffix_dedup.without_repeats(frame(spark, rows).repartition(7), hot=2).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = Counter(map(tuple, out.collect()))
    assert got == Counter((i, *w) for (i, _), w in zip(rows, brute_repeats([t for _, t in rows])))


def test_text_of_several_megabytes(spark):
    rng = random.Random(25)
    block = prose(rng, 20_000)
    long = "".join(block[k : k + 900] + prose(rng, 12) for k in range(0, 100_000, 1000)) * 28
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(frame(spark, [(1, long), (2, "head " + long[70_000:71_000]), (3, prose(rng, 300))])).select("row.doc_id", "n_removed").collect()}
    assert len(long) > 2.5 * suffix_dedup.SLICE and got[1]["n_removed"] == len(long) and got[2]["n_removed"] == 1000 and got[3]["n_removed"] == 0


def brute_words(texts, length):
    """Byte texts without the words of any run of ``length`` that occurs again."""
    split = [list(re.finditer(rb"[^\x20\t-\r]+", (t or "").encode())) for t in texts]
    own = [[m[0] for m in ms] for ms in split]
    seen = Counter(tuple(w[k : k + length]) for w in own for k in range(len(w) - length + 1))
    out = []
    for text, ms, w in zip(texts, split, own):
        raw = bytearray((text or "").encode())
        gone = [False] * len(raw)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[ms[k].start() : ms[k + length - 1].end()] = [True] * (ms[k + length - 1].end() - ms[k].start())
        out.append(bytes(b for b, g in zip(raw, gone) if not g).decode())
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_passages_of_words(spark, odd, hot):
    """Passages of over 50 words go wherever they stand, however short their words; one word less stays."""
    rng = random.Random(23)
    texts = list(odd)
    for k, n in enumerate((49, 50, 51, 52, 60, 70, 75)):
        passage = " ".join(rng.choice(["a", "of", "é", "it", "the", "rest"]) + rng.choice("bcdfg") for _ in range(n))
        texts += [(100 + 10 * k + j, f"{prose(rng, 20 + 7 * j)}\n{passage}\t {prose(rng, 9)}") for j in range(3)]
    got = sorted((r["doc_id"] or 0, r["kept_text"]) for r in suffix_dedup.without_repeats(frame(spark, texts), length=51, gram=10, words=True, hot=hot).select("row.doc_id", "kept_text").collect())
    assert got == sorted((i or 0, t) for (i, _), t in zip(texts, brute_words([t for _, t in texts], 51)))


def test_index_family_over_many_batches():
    rng = random.Random(3)
    core = prose(rng, 200)
    hulls = [(prose(rng, 60) + core + prose(rng, 60)).encode()[k : k + 700] for k in range(0, 90, 3)]
    at = [h.find(core.encode()[:80]) for h in hulls]
    groups, hi = np.zeros(len(hulls), int), np.array([min(a, 300) for a in at])
    hulls = [h[a - x : a + 400] for h, a, x in zip(hulls, at, hi)]
    lo = np.zeros(len(hulls), int)
    one, many = suffix_dedup.repeated_offsets(groups, lo, hi, hulls, batch=1000), suffix_dedup.repeated_offsets(groups, lo, hi, hulls, batch=4)
    assert np.array_equal(one[0], many[0]) and np.array_equal(one[1], many[1])
    assert (one[1] >= one[0]).any()


# -- 2 ----------------------------------------------------------------------------------------------


def test_chunked_tokens_equal_whole_ones():
    t = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (prose(random.Random(1), 900), "x <|endoftext|> y " * 90, " " * 3000, "a" * 3000, "é\n 12 don't " * 200):
        assert token_counts.chunked_ids(t, text, 500, 100) == t.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, odd):
    t = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts.token_counts(frame(spark, odd), public_tokenizers.path("byte_bpe_50k.json"), chunk=2000, overlap=200).collect()
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in odd]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in got)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


# -- 3 ----------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.vstack([base, base[:12] + rng.normal(scale=0.05, size=(12, 16)), base[:3]])
    rows = [(k, [float(v) for v in r], "z") for k, r in enumerate(x)] + [(100, None, "z"), (101, [0.0] * 16, "z"), (102, [float("nan")] + [1.0] * 15, "z"), (103, [None] + [1.0] * 15, "z"), (None, [1.0] * 16, "z")]
    got = {r["vec_id"]: r for r in vector_links.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string"), recall=0.9999).collect()}
    f = x.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    s = f @ f.T >= 0.9
    np.fill_diagonal(s, False)
    a, b = np.nonzero(s)
    root = unions.roots(len(x), a, b)
    for k in range(len(x)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (s[k].sum(), root[k], root[k] == k)
    for k in (100, 101, 102, 103):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)


def brute_vectors(rows, threshold=0.9):
    """Links and smallest reachable id of each row with an id, by exact cosines of scaled vectors of equal length."""
    sound = [(i, np.array(v, float) / max(map(abs, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = [(a, b) for a in range(len(sound)) for b in range(a) if len(sound[a][1]) == len(sound[b][1]) and sound[a][1] @ sound[b][1] >= threshold * np.sqrt((sound[a][1] @ sound[a][1]) * (sound[b][1] @ sound[b][1]))]
    n, low = Counter(), {i: i for i, _ in rows if i is not None}
    for a, b in linked:
        n[sound[a][0]] += 1
        n[sound[b][0]] += 1
    for _ in range(len(low)):
        for a, b in linked:
            low[sound[a][0]] = low[sound[b][0]] = min(low[sound[a][0]], low[sound[b][0]])
    return n, low


def test_vectors_of_all_kinds(spark):
    """Several lengths, extreme values, shared and huge ids, repeated rows."""
    rng = np.random.default_rng(14)
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1e-200, 1e-200]), (4, [1.0, -1.0]), (5, [3e-200, 3.1e-200]), (6, [1e200, 1e200]), (7, [5e-324, 5e-324]), (8, [-1e308, 1e308]), (9, []), (10, [2.0]), (11, [1e-300]), (12, [-1.0]), (12, [-3.0]), ((1 << 62) + 5, [2.0]), ((1 << 62) + 4, [2.0])]
    base = rng.normal(size=(20, 5))
    rows += [(100 + k, [float(x) for x in v]) for k, v in enumerate(np.vstack([base, base[:8] + rng.normal(scale=0.05, size=(8, 5)), base[:2]]))]
    n, low = brute_vectors(rows)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rep string, w long")
    for block in (2048, 4):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_links.near_vectors(df, recall=0.99999, block=block).collect()}
        assert got[12][1:] == (12, True) and got.pop(12)  # its two vectors link with each other
        assert got == {i: (n[i], low[i], low[i] == i) for i, _ in rows if i != 12}


def test_recall_at_the_threshold(spark):
    """Production parameters, pairs barely over the threshold: nearly all are found, and nothing below it."""
    rng = np.random.default_rng(15)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = np.where(np.arange(1500) % 3 == 0, 0.89, 0.905)[:, None]
    x = np.vstack([base, cosine * base + np.sqrt(1 - cosine**2) * aside])
    got = vector_links.near_vectors(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()
    linked = {r["vec_id"] for r in got if r["n_links"]}
    assert 0.94 * 2000 <= len(linked) and all(k % 1500 % 3 for k in linked) and all(r["component_id"] == r["vec_id"] % 1500 for r in got if r["n_links"])


def test_large_bucket_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.ones((150, 8)) + rng.normal(scale=0.02, size=(150, 8))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_links.near_vectors(df, block=16).collect()
    assert {r["n_links"] for r in got} == {149} and {r["component_id"] for r in got} == {0}


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(edges, "a long, b long"), Cuts(spark)).collect()}
    a, b = np.array(edges).T
    root = unions.roots(300, a, b)
    assert got == {k: root[k] for k in {*a.tolist(), *b.tolist()} if (root == root[k]).sum() > 1}


# -- 4 ----------------------------------------------------------------------------------------------


def test_word_ids_equal_whole_texts():
    t = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Don't stop <|endoftext|> now  12% ÉTÉ é\nx’s\tİ ﬁne", prose(random.Random(2), 50), None, "", "a" * 90 + " b"]
    rng, letters = random.Random(31), "aZéÉßÿ×÷'.<|>_-0٣²ªKİ́ \n\tﬁ’\xa0\xad中"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + [f"a{chr(c)}B {chr(c)} {chr(c)}{chr(c)}'s" for c in range(0x20, 0x180)]
    for words in (packing.WordIds(t), packing.WordIds(t, limit=50)):
        for k in range(0, len(texts), 200):
            for got, text in zip(words.encode(texts[k : k + 200]), texts[k : k + 200]):
                assert got == np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
    other = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.WordIds(other).encode(["a  b", None])[0] == np.array(other.encode("a  b", add_special_tokens=False).ids, "<u4").tobytes()


def brute_spread(sizes, windows):
    """The least difference between the fullest and the emptiest window over all ways to deal the sizes out."""
    best = None
    for way in range(windows ** len(sizes)):
        sums = [0] * windows
        for n in sizes:
            sums[way % windows] += n
            way //= windows
        best = min(max(sums) - min(sums), max(sums) if best is None else best)
    return best


def test_differencing_against_all_ways():
    """Karmarkar-Karp is no optimum, but for few pieces it stays near it, and keeps every piece once."""
    rng, worse = random.Random(19), []
    for _ in range(60):
        windows, sizes = rng.choice([2, 3]), [rng.randrange(1, 60) for _ in range(rng.randrange(3, 9))]
        sums = np.bincount(packing.differencing(sizes, windows), sizes, windows)
        assert sums.sum() == sum(sizes)
        worse.append((sums.max() - sums.min() - brute_spread(sizes, windows)) / max(sizes))
    assert min(worse) >= 0 and np.mean(worse) < 0.12 and max(worse) < 0.7


def test_differencing_is_near_equal():
    rng = random.Random(9)
    sizes = [rng.randrange(1, 1500) for _ in range(400)]
    at = packing.spread(sizes, 4096)
    sums = np.bincount(at, sizes)
    assert sums.max() <= 4096 and len(sums) <= -(-sum(sizes) // 4096) + 2
    assert np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4]).max() <= 16


def test_large_pieces_leave_no_gaps():
    lengths = [2200 + k % 9 for k in range(300)]
    sequences = packing.pack(lengths)
    assert max(sum(n for _, _, n in q) for q in sequences) <= 4096 and len(sequences) <= 1.04 * sum(lengths) / 4096 + 14
    assert sorted((d, s, n) for q in sequences for d, s, n in q if d == 0)[0][1] == 0 and sum(n for q in sequences for _, _, n in q) == sum(lengths)


def test_packing(spark, odd):
    t = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.packed(frame(spark, odd).coalesce(1), public_tokenizers.path("word_bpe_49k.json"), capacity=256).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))] and sum(r["length"] for r in own) <= 256
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in odd if i in (1, 3, 4, 8, 9)}
    for i, own in ids.items():
        pieces = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == [sum(x["length"] for x in pieces[:k]) for k in range(len(pieces))] and sum(r["length"] for r in pieces) == len(own)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in pieces)
    assert sum(r["length"] for r in got) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in odd)


# -- 5 ----------------------------------------------------------------------------------------------


def test_mixture(spark):
    rng = random.Random(6)
    docs = [(k, prose(rng, rng.randrange(1, 60)), rng.choice(["a", "b", "c", None]) if k % 3 else "a") for k in range(600)] + [(None, None, "zero"), (1, docs_text := "x y", "b")]
    frame_of = lambda: spark.createDataFrame([(*d, 1, "k", 2.0, 3) for d in docs], "doc_id long, text string, source string, size long, key string, q double, target long")
    made = lambda df: mixture.mix(df).select("row.doc_id", "size", "source_size", "target", "taken").collect()
    got, again = made(frame_of()), made(frame_of().repartition(3))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixture, "BROADCAST_SOURCES", 0)  # many sources: joined by shuffle
        assert sorted(map(repr, got)) == sorted(map(repr, made(frame_of())))
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and docs_text
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source_size"]] = r["source_size"]
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    for s, want in target.items():
        assert want <= 2 * s + 1e-9 and abs(taken[s] - want) <= 60


def test_longer_documents_are_likelier(spark):
    """Equal targets and sizes, but the sample leans to long documents, and certain ones are always in."""
    rng = random.Random(16)
    docs = [(k, prose(rng, 100 if k % 2 else 4), "ab"[k % 4 // 2]) for k in range(2000)]
    got = mixture.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), weights=(1, 9), factor=0.7, cap=1.0).select("row.doc_id", "row.source", "size", "copies", "target", "source_size").collect()
    share = lambda size: np.mean([r["copies"] for r in got if r["source"] == "a" and r["size"] == size])
    assert share(100) > 2 * share(4) and {r["copies"] for r in got if r["target"] == r["source_size"]} <= {1}


def test_equal_rows_are_taken_alike(spark):
    rows = [(None, "a b c", "s")] * 50 + [(None, f"d e {k}", "s") for k in range(50)] + [(1, "x y", "t")] * 40
    got = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("row.*", "copies", "taken", "target").collect()
    assert len(got) == 140 and len({r["copies"] for r in got if r["text"] == "a b c"}) == len({r["copies"] for r in got if r["source"] == "t"}) == 1
    for s, most in (("s", 75), ("t", 40)):  # half of the words of a text's equal rows
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= most


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_registered_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert len(want) >= 50 and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in rows.collect())


# -- 6 ----------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://Www.Example.com/en/1?q", "https://m.example.com/en/2", "https://example.com", "http://x.net/es/", "http://net/fr", None, "no scheme", "ftp://example.com/EN/", "http://example.com.evil/en/"]
    got = url_rules.url_verdicts(spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string"), queries.URL_RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("m.example.com", "/en/2", "example.com/en/", "block"), ("example.com", "", None, "allow"), ("x.net", "/es/", "net/es/", "block"),
        ("net", "/fr", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/EN/", "com/", "allow"), ("example.com.evil", "/en/", None, "allow"),
    ]


def test_urls_with_clashing_columns(spark):
    rows = [(1, "http://a.net/es/1", "p", "r", "v", "h")] * 3 + [(1, None, "p", "r", "v", "h"), (None, "http://b.com/" + "x/" * 50_000, "p", "r", "v", "h")]
    got = url_rules.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, path string, rule string, verdict string, host string"), queries.URL_RULES).collect()
    assert [tuple(r) for r in got[:4]] == [(1, "a.net", "/es/1", "net/es/", "block")] * 3 + [(1, "", "", None, "allow")] and got[4]["rule"] == "com/"


def test_rare_tokens_find_every_rule():
    rng = random.Random(11)
    hosts, paths = ["a.com", "b.a.com", "net", "x-y.org"], ["", "/", "/p", "/p/q/", "/p/zz"]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.7]
    index = url_rules.RuleIndex(rules, {"a": 9, "com": 50})
    for host in ["a.com", "b.a.com", "ba.com", "q.net", "x-y.org", "net.a.com"]:
        for path in ["", "/", "/p", "/p/q/r", "/pq", "/p/zzz"]:
            fits = [k for k, (_, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, key=index.order.__getitem__, default=None)
            assert index.match(host, path) == best


# -- 7 ----------------------------------------------------------------------------------------------

PIECE = re.compile(sketches.PARAGRAPH.replace(r"\s", r"[ \t\n\x0b\f\r]"))


def test_sketches(spark, odd):
    texts = [(i, t) for i, t in odd if i is not None and i != 7] + [(20, "A. b\n" * 50 + prose(random.Random(7), 3000)), (21, prose(random.Random(8), 3000).replace(" ", ".\n"))]
    got = {r["doc_id"]: r for r in sketches.fingerprints(frame(spark, texts)).collect()}
    order = sorted(texts, key=lambda x: x[0])
    like = lambda a, b: 1.0 if not a | b else 1 - len(a ^ b) / (len(a) + len(b))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, e = (set(PIECE.findall(x)) for x in (t, after, edited))
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == pytest.approx(like(a, e)) and got[i]["near_next"] == pytest.approx(like(a, b))
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]


def test_sketches_of_shared_ids(spark):
    """All rows of one id have the same next document, and are the next of the one before by one of them."""
    rng = random.Random(27)
    texts = [(1, prose(rng, 60)), (7, prose(rng, 50)), (7, prose(rng, 70)), (7, prose(rng, 70)), (9, prose(rng, 40))]
    got = sketches.fingerprints(frame(spark, texts)).collect()
    text = dict(texts)
    edited = lambda t, after: hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()
    assert sorted(r["edited_sha256"] for r in got if r["doc_id"] == 7) == sorted(edited(t, text[9]) for i, t in texts if i == 7)
    assert [r["edited_sha256"] for r in got if r["doc_id"] == 9] == [edited(text[9], text[1])]
    assert [r["edited_sha256"] for r in got if r["doc_id"] == 1][0] in {edited(text[1], t) for i, t in texts if i == 7}


def test_each_peeling_is_evaluated_once(spark):
    """A failed attempt may not be made again to tell that it failed."""
    lists = spark.createDataFrame([([1], [2], [0] * 48, [0] * 48)], "a array<long>, b array<long>, xa array<long>, xb array<long>")
    plan = lists.select(F.expr(sketches.difference_size("a", "b", "xa", "xb")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("-16777216") == 3  # the check of a cell, once in each of the three attempts


def test_sketch_of_both_lists_is_the_xor(spark):
    rng = random.Random(28)
    draw = lambda n: [rng.getrandbits(63) for _ in range(n)]
    common = draw(30)
    lists = spark.createDataFrame([(common + draw(9), common + draw(40)), ([], draw(3)), (common, common), ([], [])], "a array<long>, b array<long>")
    for side in ("4", "7"):
        both = f"zip_with({sketches.cells('a', side)}, {sketches.cells('b', side)}, (c, e) -> c ^ e)"
        for r in lists.select(F.expr(both).alias("x"), F.expr(sketches.cells("concat(a, b)", side)).alias("y")).collect():
            assert r["x"] == r["y"] and len(r["y"]) == 3 * int(side) ** 2


def test_sketch_without_ids(spark):
    assert sketches.fingerprints(frame(spark, [(None, "abc. def")])).first()["n_chars"] == 8


# -- 8 ----------------------------------------------------------------------------------------------


def test_gradients_match_differences():
    """Every weight of both directions and the output, with padded positions."""
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language_id.new_weights(3, 4, rng).items()}
    seq, y, mask = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.ones((7, 5, 1))
    mask[5:, 1], mask[3:, 4] = 0, 0
    seq[5:, 1], seq[3:, 4] = 0, 0
    _, grads = language_id.loss_and_grads(w, seq, mask, y)
    assert set(grads) == set(w)
    for name, g in grads.items():
        used = [(x, c) for x in np.unique(seq)[::4] for c in range(0, 12, 2)] if name[0] == "x" else list(np.ndindex(g.shape))
        for at in used:
            values = []
            for step in (1e-5, -1e-5):
                v = {**w, name: w[name].copy()}
                v[name][at] += step
                values.append(language_id.loss_and_grads(v, seq, mask, y)[0])
            assert (values[0] - values[1]) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=1e-7)


def test_position_sums_match_one_text_at_a_time():
    """Segments of all lengths in one block against each segment by itself, and pooling over a long text."""
    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b"], language_id.new_weights(2, 5, rng))
    texts = [bytes(rng.integers(97, 122, n).astype(np.uint8)).decode() for n in (1, 5, 127, 128, 129, 700)]
    _, together = language_id.predict(model, [*texts, None, "", "12"])
    assert together[6:] == [0.0, 0.0, 0.0]
    for text, score in zip(texts, together):
        raw, total = text.encode(), 0
        for at in range(0, len(raw), language_id.SEGMENT):
            seq = np.frombuffer(raw[at : at + language_id.SEGMENT], np.uint8)[:, None]
            both = np.concatenate([language_id._direction(model.weights, "f", seq), language_id._direction(model.weights, "b", seq[::-1])[::-1]], axis=2)
            p = np.exp(both @ model.weights["out"] + model.weights["bias"])
            total = total + (p / p.sum(axis=2, keepdims=True)).sum(axis=(0, 1))
        assert score == pytest.approx(total.max() / len(raw), rel=1e-4)


def test_languages(spark):
    rng = random.Random(1)
    draw = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "ein", "schön"]}
    rows = [(k, " ".join(rng.choice(draw[l]) for _ in range(40)), l) for k in range(120) for l in [rng.choice(["en", "de"])]]
    rows += [rows[0]] * 3  # repeated rows
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34", "de"), (902, "der und", None), (903, "", "en"), (None, "der und", "de"), (904, "the und " * 40_000, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.languages(docs, language_id.train(docs, steps=60, rows=32)).collect()}
    assert np.mean([got[i]["lang_pred"] == l for i, _, l in rows]) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == got[903]["lang_pred"] == "und" and got[None]["lang_pred"] == "de" and len(got) == 126 and 0 <= got[902]["score"] <= 1
    assert language_id.languages(docs, language_id.Model([], {})).first()["lang_pred"] == "und"


def test_held_out_languages(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


# -- 9 ----------------------------------------------------------------------------------------------


def brute_groups(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and 100 * len(sets[a][1] & sets[b][1]) >= 75 * len(sets[a][1] | sets[b][1])]
    root = unions.roots(len(sets), *(np.array(x, int) for x in zip(*pairs))) if pairs else np.arange(len(sets))
    return {i: (len(s), min(sets[k][0] for k in range(len(sets)) if root[k] == root[j])) for j, (i, s) in enumerate(sets)}


def test_jaccard_on_odd_rows(spark, odd):
    got = jaccard_join.jaccard_groups(frame(spark, odd)).collect()
    want = brute_groups({i: t for i, t in odd if i is not None}.items())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] is None) == [0, want[1][0]]


def test_screen_names_documents_shortly(spark):
    """In very many buckets nearly each shingle comes with its document's name: a hash, a place and a count, four bytes each."""
    rng = random.Random(14)
    docs = spark.createDataFrame([(2**60 + k, " ".join(f"w{rng.randrange(10**9)}" for _ in range(104))) for k in range(50)], "id long, text string")
    spread = jaccard_join._spread_texts(docs, 5000, 5).filter("kind = 1")
    assert spread.selectExpr("sum(length(ids) + length(counts) + length(data))").first()[0] <= 12 * 5000


@pytest.mark.parametrize("limit", [1_000_000, 600, 100])
def test_jaccard_families(spark, monkeypatch, limit):
    """Families of copies with growing distance; a small limit makes regions divide and fall to blocks."""
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", limit)
    rng = random.Random(12)
    docs = []
    for family in range(6):
        base = prose(rng, 90).split()
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
            docs.append((len(docs), " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_groups(docs)


def test_far_members_are_not_handed_on_everywhere(spark, monkeypatch):
    """An island of copies far from each other: divisions would hand each of them to all pivots, again and again."""
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", 6_000)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.r_[base[(own := rng.random(300) < rng.uniform(0.3, 1))], rng.integers(0, 2**63, int((~own).sum())).astype(np.uint64)]) for _ in range(150)]
    frame_ = spark.createDataFrame([(7, k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "region long, id long, set binary")
    handed, write = [], Cuts.write
    monkeypatch.setattr(Cuts, "write", lambda self, df: (out := write(self, df), "set" in df.columns and handed.append(out.filter("set IS NOT NULL").count()))[0])
    links = jaccard_join.metric_join(Cuts(spark), frame_, 75).collect()
    assert sum(handed) <= 3 * len(sets)
    near = [(a, b) for a in range(len(sets)) for b in range(a) if (c := len(np.intersect1d(sets[a], sets[b]))) * 100 >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    want = unions.roots(len(sets), *np.array(near).T)
    assert unions.roots(len(sets), *np.array([(r["a"], r["b"]) for r in links]).T).tolist() == want.tolist() and 1 < len(set(want.tolist())) < 150


def test_shared_phrases_do_not_join_islands(spark, monkeypatch):
    """Near copies, each pair of which shares a rare phrase with the next pair, are islands of two."""
    rng = random.Random(13)
    docs = []
    for k in range(20):
        base = [f"w{k}x{rng.randrange(10**9)}" for _ in range(100)]
        for side in (k, k + 1):
            own = list(base)
            own[40:45] = [f"phrase{side}", "of", "some", "five", "words"]
            docs.append((len(docs), " ".join(own)))
    seen, join = [], jaccard_join.metric_join
    monkeypatch.setattr(jaccard_join, "metric_join", lambda cuts, regions, *rest: (seen.extend(r["count"] for r in regions.groupBy("region").count().collect()), join(cuts, regions, *rest))[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_groups(docs) and seen == [2] * 20


def test_bitmaps_never_refuse_a_link():
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 129, 1000]:
        a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.sort(np.r_[a[n // 8 :], rng.integers(0, 2**63, n // 8).astype(np.uint64)])
        for x, y in ((a, b), (a, a[: -(-3 * n // 4)])):
            c = len(np.intersect1d(x, y))
            assert not 100 * c >= 75 * (len(x) + len(y) - c) or jaccard_join.may_link(len(x), jaccard_join.bitmap(x), len(y), jaccard_join.bitmap(y), 75)
            assert (jaccard_join.join_region(jaccard_join.Region(np.arange(2), [x, y]), 75)[1] == 0) == (100 * c >= 75 * (len(x) + len(y) - c))
    assert not jaccard_join.may_link(1000, jaccard_join.bitmap(a), 1000, jaccard_join.bitmap(a ^ np.uint64(0xFFFFFF)), 75)


# -- 10 ---------------------------------------------------------------------------------------------


def test_folding_keeps_places():
    assert toxicity.fold("Ιd1оt!") == " idioti " and toxicity.fold(None) == "  "
    assert all(len(toxicity.fold(t)) == len(t) + 2 for t in ("ＦＵＬＬ", "aé𝐱", "x\n\t1"))


def test_exceptions_spare_their_words():
    lexicon = toxicity.Lexicon({" clown ": 5.0, " vequ": 4.0}, [toxicity.fold("clown fish")], (-3.0, 1.0, 1.0))
    a = lexicon.automaton()
    assert toxicity.measure(a, toxicity.fold("a clown fish"))[0] == 0
    assert toxicity.measure(a, toxicity.fold("a cl0wn, vequxy"))[0] == 9.0
    assert toxicity.scores(lexicon, a, [None, "", "clown clown clown"])[2] > toxicity.scores(lexicon, a, [None])[0]


def test_automaton_against_naive_search():
    """Hits, the longest-weighing one of each place, and exceptions over them, by looking everywhere."""
    rng = random.Random(17)
    for _ in range(300):
        draw = lambda n: "".join(rng.choice("ab ") for _ in range(n))
        text = toxicity.fold(draw(rng.randrange(0, 60)))
        weights = {p: float(rng.randrange(1, 9)) for p in {" " + draw(rng.randrange(1, 4)) for _ in range(5)}}
        spared = list({" " + draw(rng.randrange(2, 8)) for _ in range(4)} - set(weights))
        total = 0.0
        for at in range(len(text)):
            hits = [w for p, w in weights.items() if text.startswith(p, at)]
            if hits and not any(text.startswith(e, a) and a <= at < a + len(e) - 1 for e in spared for a in range(at + 1)):
                total += max(hits)
        assert toxicity.measure(toxicity.Lexicon(weights, spared).automaton(), text)[0] == pytest.approx(total)


def test_held_out_toxicity(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL").select("doc_id", "toxic")
    got = queries.op10_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    bad, clean = ([r["score"] for r in got if r["toxic"] == k] for k in (1, 0))
    area = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in clean])
    assert len(bad) > 10 and area > 0.85 and np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.93  # some labels are noise


def test_toxicity_of_odd_rows(spark):
    """Repeated, very long and wordless texts, clashing column names, null ids."""
    lexicon = toxicity.Lexicon({" zorgon ": 5.0}, [], (-3.0, 1.0, 1.0))
    rows = [(1, "zorgon zorgon"), (1, "zorgon zorgon"), (None, "zorgon"), (2, "a b " * 200_000 + "Z0rg0n"), (3, "!!"), (4, ""), (5, None)]
    got = toxicity.toxicity(spark.createDataFrame([(i, t, 9.0, 1, "x") for i, t in rows], "doc_id long, text string, score double, predicted int, key string"), lexicon).collect()
    assert len(got) == 7 and got[0] == got[1] and got[2]["score"] > got[3]["score"] > got[4]["score"] == got[5]["score"] == got[6]["score"]


def test_toxicity(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        text = prose(rng, 40) + (" zorgon blurgh " + prose(rng, 10) if bad else "")
        docs.append((k, text))
        labels.append((k, int(bad)))
    d, l = spark.createDataFrame([*docs, (999, None), (None, "x")], "doc_id long, text string"), spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, toxicity.train(d, l.filter("doc_id % 3 <> 1"))).collect()}
    held = [k for k in range(300) if k % 3 == 1]
    assert all(got[k]["predicted"] == int(k % 4 == 0) for k in held) and got[999]["predicted"] == 0
    assert toxicity.toxicity(d, toxicity.train(d, l.filter("false"))).agg(F.max("predicted")).first()[0] == 0


def test_rare_toxic_words(spark):
    """A word counts by the texts that hold it, not by its share of all toxic ones."""
    rng = random.Random(4)
    rare = [f"{a}{b}orx" for a in ("zu", "qua", "vly", "kro", "jem") for b in "bdfgklmnpstvwz"]
    docs = [(k, prose(rng, 30) + (f" {rare[k // 4 % 70]} " + prose(rng, 5) if k % 4 == 0 else "")) for k in range(1680)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in docs], "doc_id long, toxic int")
    lexicon = toxicity.train(d, l.filter("doc_id >= 280"))
    assert all(any(f" {w} ".startswith(t) for t in lexicon.weights) for w in rare)
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in toxicity.toxicity(d, lexicon).filter("doc_id < 280").collect())


# -- all --------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    results = [
        suffix_dedup.without_repeats(none), token_counts.token_counts(none, vocabulary), packing.packed(none, vocabulary), mixture.mix(none), sketches.fingerprints(none), jaccard_join.jaccard_groups(none),
        language_id.languages(none, language_id.train(none)), toxicity.toxicity(none, toxicity.Lexicon()), url_rules.url_verdicts(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES),
        vector_links.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ]
    assert all(r.count() == 0 for r in results)


# -- batches to the workers ---------------------------------------------------------------------------


@pytest.fixture
def batch_bytes(spark):
    """The session's own size of a batch, put back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    yield key
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_workers_get_small_batches(spark, batch_bytes):
    import pyarrow as pa

    docs = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefghij"), 1000).alias("text"))
    held = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}) for b in batches), "rows long, size long")
    assert held.agg(F.max("size")).first()[0] > 20_000_000
    suffix_dedup.without_repeats(docs.limit(2))  # its rows take their batches when they are read
    rows = held.collect()
    assert sum(r["rows"] for r in rows) == 2500 and max(r["size"] for r in rows) < 8_000_000
    spark.conf.set(batch_bytes, "1000000")
    suffix_dedup.without_repeats(docs.limit(2))
    assert spark.conf.get(batch_bytes) == "1000000"


def test_pipeline_stages_get_small_batches(spark, batch_bytes):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if name != "mixture":  # starts no Python
            spark.conf.unset(batch_bytes)
            stage(spark, docs, SF)
            assert spark.conf.get(batch_bytes) == "7900000", name
