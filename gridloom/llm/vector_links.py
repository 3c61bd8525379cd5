r"""Near-duplicate vectors: sign hashing in several tables, exact cosines, connected components.

Equal vectors collapse to one with a count. ``tables`` sets of ``bits`` random hyperplanes give each
vector a key per table; vectors of one length that share a key are compared exactly, in double precision, and a
pair counts in the first table that brings it together, so link counts need no list of pairs. ``bits`` follows
the row count (about one vector a bucket, without a ceiling); ``tables`` follows from it so that a pair at the
threshold itself meets with probability ``recall``, closer pairs almost surely. Keys and ids find the buckets with
company; only for those are vectors fetched, and they are shuffled once. Buckets over ``block`` rows are dealt out as
pairs of blocks, each a task's work of at most 2 x ``block`` vectors, all of which are compared. Tasks return
link counts and one edge per linked vector to its local root; components join those.

Vectors are scaled by a power of two first, which changes no digit, so that squares neither under- nor overflow.

Edge cases: vectors that are null, empty or zero, or that hold null or non-finite components link with
nothing (n_links 0, component_id the own id, kept true); vectors of other lengths are compared among themselves.
Rows with a null id link with nothing and get a null component and kept false. Repeated rows are vectors of their
own that link with each other; rows that share an id are one node, linked by any of its vectors, and each row
reports the node's links. Other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Cuts, arrow_schema, components
from gridloom.llm.unions import pairs_within, roots

SMALL = 48  # buckets up to this size are compared many at a time


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    bits = max(6, math.ceil(math.log2(max(2, n))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to [0.5, 1)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def planes(dims: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).normal(size=(dims, tables * bits))


def signatures(x: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    sides = (x @ h > 0).reshape(len(x), -1, bits)
    return (sides * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _hits(x, norm, sig, table, block, crossing, threshold):
    """Pairs of one large bucket that link and meet here first, tile by tile."""
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        ok = s >= threshold * norm[at : at + 512, None] * norm[None, :]
        ok &= np.arange(at, at + len(ok))[:, None] < np.arange(len(x))[None, :]
        if crossing:
            ok &= block[at : at + 512, None] != block[None, :]
        a, b = np.nonzero(ok)
        a += at
        for k in range(0, len(a), 1 << 20):
            p, q = a[k : k + (1 << 20)], b[k : k + (1 << 20)]
            first = np.ones(len(p), bool)
            for t in range(table):
                first &= sig[p, t] != sig[q, t]
            yield p[first], q[first], p, q


def link_block(ids, weight, x, sig, table, block, crossing, sizes, threshold):
    """Links and local roots of consecutive buckets. Returns (links per row, root row per row)."""
    n = len(ids)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    links = np.zeros(n, np.int64)
    if len(sizes) == 1 and sizes[0] > SMALL:
        label = np.arange(n)
        for p, q, all_p, all_q in _hits(x, norm, sig, table[0], block, crossing[0], threshold):
            links += np.bincount(p, weight[q], n).astype(np.int64) + np.bincount(q, weight[p], n).astype(np.int64)
            open_ = label[all_p] != label[all_q]
            if open_.any():
                label = roots(n, np.r_[np.arange(n), all_p[open_]], np.r_[label, all_q[open_]])
        return links, label
    a, b = pairs_within(sizes)
    keep = ~crossing[a] | (block[a] != block[b])
    a, b = a[keep], b[keep]
    hit = np.einsum("ij,ij->i", x[a], x[b]) >= threshold * norm[a] * norm[b]
    a, b = a[hit], b[hit]
    early = np.arange(sig.shape[1])[None, :] < table[a][:, None]
    first = ~((sig[a] == sig[b]) & early).any(axis=1)
    links += np.bincount(a[first], weight[b[first]], n).astype(np.int64) + np.bincount(b[first], weight[a[first]], n).astype(np.int64)
    return links, roots(n, a, b)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, block: int = 2048, seed: int = 11,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept`` per row; the id column holds integers."""
    spark = vectors.sparkSession
    cuts = Cuts(spark)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0.0)
    # equal vectors: one row, counted before the shuffle
    reps = cuts.write(rows.filter(sound).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("w")))
    linked = _links(cuts, reps, reps.count(), threshold, recall, block, seed)
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(spark, linked.filter("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")), cuts)
    own = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # every row finds its representative; rows of one id share its node
    member = own.filter("sound").join(reps, "v").select("id", "rep", "w").distinct()
    member = member.join(links, "rep", "left").groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("rep2"), F.sum(F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    same = comp.select(F.col("node").alias("rep"), "component")
    out = (
        vectors.select(F.col(id_col), F.col(id_col).cast("long").alias("_id")).join(member.withColumnRenamed("id", "_id"), "_id", "left")
        .join(same, "rep", "left")
        .select(F.col(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep", "_id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col).cast("long") == F.col("component_id"), F.lit(False)))


_HASHED = "d int, rep long, w long, x binary, sig binary"
_DEALT = ("d", "t", "k", "i", "j", "mine", "rep", "w", "x", "sig")


def _links(cuts: Cuts, reps: DataFrame, n: int, threshold: float, recall: float, block: int, seed: int) -> DataFrame:
    """``rep, links, root``: links found in one bucket, and the smallest vector that it joins there."""
    bits, tables = plan_tables(n, threshold, recall)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, known = arrow_schema(_HASHED), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes = np.asarray(pa.compute.list_value_length(batch.column(0)))
                for d in np.unique(sizes).tolist():
                    own = batch.filter(pa.array(sizes == d))
                    if d not in known:
                        known[d] = planes(d, bits, tables, seed)
                    x = scaled(np.asarray(own.column(0).flatten()).reshape(-1, d))
                    raw, sigs = ([r.tobytes() for r in y] for y in (x, signatures(x, known[d], bits)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), own.column(1), own.column(2), pa.array(raw, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("d int, t int, k long, rep long")
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(-1, tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(sig), t, np.int32)), pa.array(np.ascontiguousarray(sig[:, t])), batch.column(1)], schema=schema)

    hashed = cuts.write(reps.select("v", "rep", "w").mapInArrow(hash_rows, _HASHED))
    keys = hashed.select("d", "rep", "sig").mapInArrow(keys_of, "d int, t int, k long, rep long")
    shared = keys.groupBy("d", "t", "k").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = (
        keys.join(shared, ["d", "t", "k"])
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep")
    )
    fetched = dealt.join(hashed, "rep").select(*_DEALT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("rep long, links long, root long")
        for key, ids, weight, mine, x, sig in _buckets(batches, tables):
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[starts, len(key)])
            k = 0
            while k < len(sizes):  # small buckets together, a large one by itself
                e = k + 1
                if sizes[k] <= SMALL:
                    total = sizes[k]
                    while e < len(sizes) and sizes[e] <= SMALL and total < 4096:
                        total += sizes[e]
                        e += 1
                s = slice(starts[k], starts[k] + sizes[k:e].sum())
                links, root = link_block(ids[s], weight[s], x[s], sig[s], key[s, 1], mine[s], key[s, 3] != key[s, 4], sizes[k:e], threshold)
                low = np.full(len(links), np.iinfo(np.int64).max)
                np.minimum.at(low, root, ids[s])
                hit = (links > 0) | (low[root] != ids[s])
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s][hit]), pa.array(links[hit]), pa.array(low[root][hit])], schema=schema)
                k = e

    return cuts.write(fetched.repartition(*_DEALT[:5]).sortWithinPartitions(*_DEALT[:5]).mapInArrow(compare, "rep long, links long, root long"))


def _keys_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(k)) for k in range(5)])


def _buckets(batches: Iterator[pa.RecordBatch], tables: int):
    """Whole buckets of one vector length at a time: rows of the last key wait for the next batch."""
    held: list[pa.RecordBatch] = []

    def arrays():
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        key = _keys_of(b)
        cuts = np.flatnonzero(np.r_[True, key[1:, 0] != key[:-1, 0], True])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = b.slice(lo, hi - lo)
            x = np.frombuffer(b"".join(part.column(8).to_pylist()), np.float64).reshape(hi - lo, -1)
            sig = np.frombuffer(b"".join(part.column(9).to_pylist()), np.int64).reshape(-1, tables)
            yield key[lo:hi], np.asarray(part.column(6)), np.asarray(part.column(7)), np.asarray(part.column(5)), x, sig

    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            key = _keys_of(part)
            last = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])[-1])
            if held and tuple(key[0]) != tuple(_keys_of(held[-1].slice(held[-1].num_rows - 1))[0]):
                yield from arrays()
            if last:
                held.append(part.slice(0, last))
                yield from arrays()
            held.append(part.slice(last))
    if held:
        yield from arrays()
