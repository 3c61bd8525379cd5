r"""Exact Jaccard join of documents on word n-grams, as a join in a metric space.

1. Screen. A linked document shares at least ``similarity`` of its shingles with its partner, so at least
   that share occurs in two documents. Shingle hashes go to buckets as packed arrays, each bucket counts
   documents per hash, and documents without the share are alone. (Bucket and 32 further bits name a
   hash here; a collision only lets a document through.)
2. Equal sets collapse to their smallest id.
3. Islands. The screen is repeated on the remaining sets, as copies no longer vouch for each other. Shingles are
   ordered by how many of these sets hold them; a linked pair shares one of each side's first
   n - ceil(similarity * n) + 1 (prefix filter). Such a candidate pair is only kept if sizes and bitmaps allow a link
   (bits that differ are at most the shingles that differ, which is exact), so sets that share a phrase by
   chance don't grow together. A shingle's sets are tried against the smallest id; where one fails, all their
   pairs are tried, or beyond ``PAIRED`` sets all stay together. Connected components are islands: no link leaves one.
4. Metric join. Jaccard distance is a metric. Pivots, no two of them within the radius, divide an island into
   Voronoi regions: a document goes to its nearest pivot and, by the triangle inequality, as a guest to
   every earlier pivot at most twice the radius further (a linked pair meets at the earlier of its two pivots). Documents within the radius of a pivot are its core: they link
   with it at once and need no comparison among each other, so a region that is all core is done.
   Regions divide again; where a division would hand on over ``GROWTH`` times its shingles (sets far from every pivot
   would be guests everywhere, and three rounds of that fill the disk) it is not made, and the region is
   dealt out as pairs of blocks. An island of at
   most ``TASK_SHINGLES`` is divided inside one task, by the same pivots and windows, as handing it on would cost a
   shuffle and save nothing: there a pivot is compared exactly with every member in its window whose bitmap allows a link, and a
   member needs no comparison of its own once all members that the distances to earlier pivots leave
   possible are in its component already.
5. Components of the links give the smallest reachable id.

Edge cases: null, empty and blank texts have no shingles and link with nothing; fewer words than the
shingle size make one shingle; rows that share an id count as one document with one result row (of the
largest set); rows with a null id get a null component; other columns are dropped; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Cuts, arrow_schema, broadcast_if_small, components, map_texts, slices
from gridloom.llm.shingles import shingle_set

SPREAD = "bucket int, chunk long, kind int, ids binary, counts binary, data binary"
TASK_SHINGLES = 3_000_000  # some 24 MB of hashes
BUCKET_SHINGLES = 8_000_000  # hashes counted at once; with their order some 200 MB
PIVOTS = 12
GROWTH = 1.5  # a division must not hand on more than so many times the shingles it was given
PAIRED = 64  # sets of a shingle of which all pairs are tried


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


# -- packed hashes ----------------------------------------------------------------------------------


def packed(ids: np.ndarray, sets: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, ids, hashes for each id, hashes) of a batch of sets."""
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order, bucket = _in_buckets(h, buckets)
    doc, low = doc[order], h[order].astype(np.uint32)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for lo, hi in zip(edges[:-1], edges[1:]):
        d = doc[lo:hi]
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        yield int(bucket[lo]), ids[d[cut]].tobytes(), np.diff(np.r_[cut, hi - lo]).astype(np.int32).tobytes(), low[lo:hi].tobytes()


def _spread_texts(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SPREAD)
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, 1):
                ids = np.asarray(batch.column(0))
                sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
                rows = [(b, chunk, 1, i, c, d) for b, i, c, d in packed(np.arange(len(sets), dtype=np.int32), sets, buckets)]
                digests = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
                rows.append((chunk % buckets, chunk, 0, ids.tobytes(), np.array([len(s) for s in sets], np.int32).tobytes(), digests))
                chunk += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("id", "text").mapInArrow(run, SPREAD)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one bucket at a time from batches sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if rows:
                    yield now, rows
                now, rows = row["bucket"], []
            rows.append(row)
    if rows:
        yield now, rows


def _frequencies(h: np.ndarray) -> np.ndarray:
    """For each value the number of its occurrences (a document holds a hash once)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    edges = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    df = np.empty(len(h), np.uint32)
    df[order] = np.repeat(np.diff(edges), np.diff(edges))
    return df


def _screen(spread: DataFrame, buckets: int) -> DataFrame:
    """``id, n, digest, shared``: how many of a document's shingles others hold. Counts come back chunk by chunk, by place there:
    in many buckets nearly each shingle comes with the name of its document, which should be short."""
    ddl = "chunk long, kind int, ids binary, counts binary, data binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for _, rows in _by_bucket(batches):
            out = [(r["chunk"], 0, r["ids"], r["counts"], r["data"]) for r in rows if r["kind"] == 0]
            rows = [r for r in rows if r["kind"] == 1]
            if rows:
                df = _frequencies(np.frombuffer(b"".join(r["data"] for r in rows), np.uint32))
                end = 0
                for r in rows:
                    counts = np.frombuffer(r["counts"], np.int32)
                    begin, end = end, end + int(counts.sum())
                    shared = np.add.reduceat((df[begin:end] > 1).astype(np.int32), np.cumsum(counts) - counts)
                    hit = shared > 0
                    out.append((r["chunk"], 1, np.frombuffer(r["ids"], np.int32)[hit].tobytes(), shared[hit].astype(np.int32).tobytes(), b""))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("id long, n int, digest binary, shared long")
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                own = next(p for p in parts if p["kind"] == 0)
                ids, d = np.frombuffer(own["ids"], np.int64), own["data"]
                total = np.zeros(len(ids), np.int64)
                for p in parts:
                    if p["kind"] == 1:
                        total[np.frombuffer(p["ids"], np.int32)] += np.frombuffer(p["counts"], np.int32)  # a place once in each bucket
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.frombuffer(own["counts"], np.int32)), pa.array([d[k : k + 16] for k in range(0, len(d), 16)], pa.binary()), pa.array(total)], schema=schema)

    counted = spread.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, ddl)
    gathered = counted.groupBy("chunk").agg(F.collect_list(F.struct("kind", "ids", "counts", "data")).alias("parts"))  # one batch of texts
    return gathered.select("parts").mapInArrow(add, "id long, n int, digest binary, shared long")


CHUNKS = "chunk long, ids binary, counts binary, data binary"


def _chunks(sets: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """``chunk, ids, counts, data``: sets packed to about ``limit`` hashes a row (one set at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(CHUNKS)
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, 1, 8 * limit):
                data = batch.column(1).to_pylist()
                counts = np.array([len(d) // 8 for d in data], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in (np.asarray(batch.column(0)).tobytes(), counts.tobytes(), b"".join(data)))], schema=schema)
                number += 1

    return sets.select("id", "set").mapInArrow(run, CHUNKS)


def _of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Chunk number, ids, sizes and hashes, and the columns after them."""
    for batch in batches:
        for chunk, ids, counts, data, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            yield chunk, np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32), np.frombuffer(data, np.uint64), *rest


def _unpacked(chunks: DataFrame) -> DataFrame:
    """``id, set`` of packed sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("id long, set binary")
        for _, ids, counts, h in _of_chunks(batches):
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([h[e - c : e].tobytes() for e, c in zip(ends, counts)], pa.binary())], schema=schema)

    return chunks.select("chunk", "ids", "counts", "data").mapInArrow(run, "id long, set binary")


def _in_buckets(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by bucket, and the buckets in that order."""
    bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets < 65536 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _rarity(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunk, bucket, df``: how many sets hold each hash of a chunk, bucket by bucket, in the chunk's order."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("chunk long, bucket int, data binary")
        for chunk, _, _, h in _of_chunks(batches):
            order, bucket = _in_buckets(h, buckets)
            low = h[order].astype(np.uint32)
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            parts = [(chunk, int(bucket[a]), low[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*parts), schema)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("chunk long, bucket int, df binary")
        for bucket, rows in _by_bucket(batches):
            df = _frequencies(np.frombuffer(b"".join(r["data"] for r in rows), np.uint32))
            ends = np.cumsum([len(r["data"]) // 4 for r in rows])
            parts = [df[e - len(r["data"]) // 4 : e].tobytes() for e, r in zip(ends, rows)]
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows]), pa.array(np.full(len(rows), bucket, np.int32)), pa.array(parts, pa.binary())], schema=schema)

    return chunks.mapInArrow(spread, "chunk long, bucket int, data binary").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "chunk long, bucket int, df binary")


def _prefixes(chunks: DataFrame, rarity: DataFrame, buckets: int, percent: int) -> DataFrame:
    """``h, id``: the shared shingles of each set's prefix, rarest first; none of sets that don't share enough."""
    parts = rarity.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "df"))).alias("parts")).select("chunk", F.transform("parts", lambda p: p["df"]).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("h long, id long")
        for _, ids, counts, h, parts in _of_chunks(batches):
            df = np.empty(len(h), np.uint32)
            df[_in_buckets(h, buckets)[0]] = np.frombuffer(b"".join(parts), np.uint32)
            hs, docs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, e, c in zip(ids, np.cumsum(counts), counts):
                own, f = h[e - c : e], df[e - c : e]
                if 100 * np.count_nonzero(f > 1) < percent * int(c):
                    continue
                first = np.lexsort((own, f))[: prefix_length(int(c), percent)]
                first = first[f[first] > 1]
                hs.append(own[first].view(np.int64))
                docs.append(np.full(len(first), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(docs))], schema=schema)

    return chunks.join(parts, "chunk").select("chunk", "ids", "counts", "data", "parts").mapInArrow(run, "h long, id long")


# -- candidate pairs --------------------------------------------------------------------------------


def _places(n: int) -> int:
    return 1 << max(6, (2 * n - 1).bit_length())


def _bits(h: np.ndarray, places: int) -> np.ndarray:
    bits = np.zeros(places, np.uint8)
    bits[(h & np.uint64(places - 1)).astype(np.int64)] = 1
    return bits


def bitmap(h: np.ndarray) -> int:
    """A bit for each hash, in a power of two of at least twice as many places."""
    return int.from_bytes(np.packbits(_bits(h, _places(len(h))), bitorder="little").tobytes(), "little")


def may_link(na: int, a: int, nb: int, b: int, percent: int) -> bool:
    """Whether sizes and bitmaps allow a link: each bit that differs is a shingle that differs."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    places_a, places_b = _places(na), _places(nb)
    while places_a > places_b:
        places_a >>= 1
        a = (a >> places_a) | (a & ((1 << places_a) - 1))
    while places_b > places_a:
        places_b >>= 1
        b = (b >> places_b) | (b & ((1 << places_b) - 1))
    return (a ^ b).bit_count() * (100 + percent) <= (na + nb) * (100 - percent)


def _bitmaps(chunks: DataFrame) -> DataFrame:
    """``id, n, bits`` of packed sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("id long, n int, bits binary")
        for _, ids, counts, h in _of_chunks(batches):
            made = (bitmap(h[e - c : e]) for e, c in zip(np.cumsum(counts), counts))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array([b.to_bytes(-(-b.bit_length() // 8), "little") for b in made], pa.binary())], schema=schema)

    return chunks.select("chunk", "ids", "counts", "data").mapInArrow(run, "id long, n int, bits binary")


def _tried(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """``a, b, fits`` of pairs of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("a long, b long, fits boolean")
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
            fits = [may_link(na, int.from_bytes(a, "little"), nb, int.from_bytes(b, "little"), percent) for na, a, nb, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fits, pa.bool_())], schema=schema)

    one, two = (bitmaps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(run, "a long, b long, fits boolean")


def candidate_links(cuts: Cuts, prefixes: DataFrame, chunks: DataFrame, percent: int) -> DataFrame:
    """``a, b`` edges whose components hold all links."""
    bitmaps = cuts.write(_bitmaps(chunks))
    least = prefixes.groupBy("h").agg(F.min("id").alias("b"), F.count("*").alias("c")).filter("c > 1")
    stars = cuts.write(prefixes.join(least, "h").filter("id <> b").select("h", F.col("id").alias("a"), "b", "c"))
    tried = cuts.write(_tried(stars.select("a", "b").distinct(), bitmaps, percent))
    mixed = cuts.write(stars.join(tried.filter("NOT fits"), ["a", "b"]).select("h", "c").distinct())
    few = prefixes.join(mixed.filter(F.col("c") <= PAIRED).select("h"), "h")
    pairs = few.select("h", F.col("id").alias("a")).join(few.select("h", F.col("id").alias("b")), "h").filter("a > b").select("a", "b").distinct()
    pairs = _tried(pairs.join(tried, ["a", "b"], "left_anti"), bitmaps, percent)
    kept = stars.join(mixed.filter(F.col("c") > PAIRED).select("h"), "h").select("a", "b")
    return tried.filter("fits").select("a", "b").union(pairs.filter("fits").select("a", "b")).union(kept)


# -- inside a task ----------------------------------------------------------------------------------


class Region:
    """Sets of one region, laid end to end."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]):
        self.ids, self.n = ids, np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.n)
        self.flat = np.concatenate(sets)
        self.sets = sets
        self._maps: dict[int, np.ndarray] = {}  # by places: bitmaps of the members that have so many
        self.places = np.array([_places(k) for k in self.n.tolist()], np.int64)
        self.row = np.empty(len(sets), np.int64)
        for p in np.unique(self.places).tolist():
            mine = np.flatnonzero(self.places == p)
            self.row[mine] = np.arange(len(mine))
            self._maps[p] = np.vstack([np.packbits(_bits(sets[k], p), bitorder="little").view(np.uint64) for k in mine])
            if p > 64:  # folded, to go with half as many
                self._maps[-p] = self._maps[p][:, : p // 128] | self._maps[p][:, p // 128 :]

    def may_link(self, k: int, members: np.ndarray, percent: int) -> np.ndarray:
        """The members, all of sizes that allow a link with the k-th, whose bitmaps allow it too."""
        p = int(self.places[k])
        kept = []
        for q in (p // 2, p, 2 * p):
            mine = members[self.places[members] == q]
            if not len(mine):
                continue
            maps = self._maps[-q] if q > p else self._maps[q]
            own = self._maps[-p] if q < p else self._maps[p]
            differ = np.bitwise_count(maps[self.row[mine]] ^ own[self.row[k]]).sum(axis=1, dtype=np.int64)
            kept.append(mine[differ * (100 + percent) <= (self.n[mine] + self.n[k]) * (100 - percent)])
        return np.sort(np.concatenate(kept)) if kept else members[:0]

    def common(self, pivot: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a set with members of the region."""
        if len(members) == len(self.n):
            flat, n = self.flat, self.n
        else:
            flat, n = np.concatenate([self.sets[k] for k in members]), self.n[members]
        at = np.searchsorted(pivot, flat)
        at[at == len(pivot)] = 0
        return np.add.reduceat((pivot[at] == flat).astype(np.int64), np.cumsum(n) - n)


def join_region(region: Region, percent: int, core: np.ndarray | None = None) -> np.ndarray:
    """For each member the smallest index in its component: exact, by pivots and triangle windows. ``core`` members are linked already."""
    n, count = region.n, len(region.n)
    label = np.arange(count)
    if core is not None and core.any():
        label[core] = np.flatnonzero(core)[0]
    done = np.zeros(count, bool)
    radius = 1 - percent / 100 + 1e-9
    distances: list[np.ndarray] = []  # to pivots that were compared with all members
    everyone = np.arange(count)
    for k in np.lexsort((region.ids, n)):
        if done[k]:
            continue
        window = (label != label[k]) & ~done
        window &= (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
        for d in distances:
            window &= np.abs(d - d[k]) <= radius
        members = np.flatnonzero(window)
        done[k] = True
        if not len(members):
            continue
        whole = 4 * len(members) > count and len(distances) < PIVOTS
        members = everyone if whole else region.may_link(k, members, percent)
        if not len(members):
            continue
        common = region.common(region.sets[k], members)
        if whole:
            distances.append(1 - common / (n + n[k] - common))
        hit = members[linked(common, n[members], n[k], percent)]
        if len(hit):
            old = np.unique(label[hit])
            low = min(old.min(), label[k])
            label[np.isin(label, np.r_[old, label[k]])] = low
    return label


# -- regions ----------------------------------------------------------------------------------------


_REGION = "parent long, region long, id long, n int, core boolean, pivot long"


def _distances(h: np.ndarray, pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles with each pivot, and the distances."""
    common = np.array([len(np.intersect1d(h, q, assume_unique=True)) for q in pivots])
    return common, 1 - common / (len(h) + np.array([len(q) for q in pivots]) - common)


def _divide(cuts: Cuts, rows: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """One Voronoi step. Rows with a ``region`` are members of it, those with a ``pivot`` links to it. No sets are handed on yet."""
    one = F.struct("id", "set")
    pivots = rows.groupBy("region").agg(*(F.min_by(one, F.struct(F.xxhash64("region", "id", F.lit(k)), "id")).alias(f"p{k}") for k in range(PIVOTS)))
    spread = weights.withColumn("salts", F.ceil(F.col("weight") / TASK_SHINGLES).cast("int"))
    lead = pivots.join(spread, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.array(*(F.col(f"p{k}") for k in range(PIVOTS))).alias("pivots"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("set"), F.lit(0).alias("kind"))
    body = rows.join(spread, "region").select("region", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(None).cast("array<struct<id:bigint,set:binary>>").alias("pivots"), "id", "set", F.lit(1).alias("kind"))
    radius = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_REGION)
        pivots: list[np.ndarray] = []
        for batch in batches:
            out = []
            for region, _, p, i, s, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    pivots, ids = [], []
                    for own in p:  # no two within the radius
                        h = np.frombuffer(own["set"], np.uint64)
                        if not pivots or _distances(h, pivots)[1].min() > radius:
                            pivots.append(h)
                            ids.append(own["id"])
                    sizes = np.array([len(q) for q in pivots])
                    continue
                h = np.frombuffer(s, np.uint64)
                common, d = _distances(h, pivots)
                core, at = linked(common, sizes, len(h), percent), int(d.argmin())
                for k in range(len(pivots)):
                    if core[k] and ids[k] != i:
                        out.append((region, None, i, None, None, ids[k]))
                    if k == at or k < at and d[k] <= d[at] + 2 * radius:
                        out.append((region, xxhash.xxh3_64_intdigest(f"{region}:{k}") >> 1, i, len(h), bool(core[k]), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    both = lead.unionByName(body).repartition("region", "salt").sortWithinPartitions("region", "salt", "kind")
    return cuts.write(both.select("region", "salt", "pivots", "id", "set", "kind").mapInArrow(run, _REGION))


def _join_regions(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: each member with the smallest member of its component; rows: ``region, i, j, id, set, core``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("a long, b long")
        key, ids, sets, cores = None, [], [], []

        def made() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1 and not all(cores):
                order = np.argsort(ids)
                region = Region(np.array(ids)[order], [np.frombuffer(sets[k], np.uint64) for k in order])
                label = join_region(region, percent, np.array(cores)[order])
                hit = label != np.arange(len(label))
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(region.ids[hit]), pa.array(region.ids[label[hit]])], schema=schema)

        for batch in batches:
            for region, i, j, doc, s, core in zip(*(c.to_pylist() for c in batch.columns)):
                if (region, i, j) != key:
                    yield from made()
                    key, ids, sets, cores = (region, i, j), [], [], []
                ids.append(doc)
                sets.append(s)
                cores.append(core)
        yield from made()

    return rows.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j").select("region", "i", "j", "id", "set", "core").mapInArrow(run, "a long, b long")


def _blocks(large: DataFrame, members: list[str]) -> DataFrame:
    """Regions with their ``weight`` as pairs of blocks, two of which make a task's worth."""
    blocks = F.ceil(2 * F.col("weight") / TASK_SHINGLES).cast("int")
    dealt = large.withColumn("mine", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select(*members, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def metric_join(cuts: Cuts, regions: DataFrame, percent: int, rounds: int = 3) -> DataFrame:
    """Links of ``region, id, set`` as ``a, b`` edges that have the same components as all links."""
    members = ["region", "id", "set", "core"]
    weight = F.sum("n").alias("weight")
    open_ = (F.count("*") > 1) & (F.sum(F.when(F.col("core"), 0).otherwise(1)) > 0)  # a region that is all core is done
    large = regions.withColumn("core", F.lit(False))
    weights = cuts.write(large.groupBy("region").agg(F.sum(F.length("set") / 8).cast("long").alias("weight"), open_.alias("open")).filter("open").select("region", "weight"))
    rows = links = None
    for k in range(rounds + 1):
        small = large.join(weights.filter(F.col("weight") <= TASK_SHINGLES), "region").select(*members, F.lit(0).alias("i"), F.lit(0).alias("j"))
        rows = small if rows is None else rows.unionByName(small)
        big = weights.filter(F.col("weight") > TASK_SHINGLES)
        if big.isEmpty():
            break
        large = large.join(big.select("region"), "region")
        if k == rounds:
            rows = rows.unionByName(_blocks(large.join(big, "region"), members))
            break
        made = _divide(cuts, large.select("region", "id", "set"), big, percent)
        direct = made.filter("pivot IS NOT NULL").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        links = direct if links is None else links.union(direct)
        parts = cuts.write(made.filter("pivot IS NULL").groupBy("parent", "region").agg(weight, open_.alias("open")).filter("open").select("parent", "region", "weight"))
        grown = big.join(parts.groupBy("parent").agg(F.sum("weight").alias("handed")), F.col("region") == F.col("parent")).filter(F.col("handed") > GROWTH * F.col("weight")).select("region", "weight")
        rows = rows.unionByName(_blocks(large.join(grown, "region"), members))
        weights = parts.join(grown.select(F.col("region").alias("parent")), "parent", "left_anti")
        sets = large.select(F.col("region").alias("parent"), "id", "set")
        large = cuts.write(made.filter("pivot IS NULL").join(weights.select("parent", "region"), ["parent", "region"]).join(sets, ["parent", "id"]).select(*members))
        weights = cuts.write(weights.select("region", "weight"))
    inside = cuts.write(_join_regions(rows, percent))
    return inside if links is None else inside.union(links)


def jaccard_groups(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id``; the id column holds integers."""
    spark = docs.sparkSession
    cuts, search, join = Cuts(spark), Cuts(spark), Cuts(spark)  # only the first is read by the result
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = rows.filter("id is not null")
    # a word and its space are two bytes at least, and five or more on average: buckets follow the text, not the cluster
    size_of = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size_of // (5 * BUCKET_SHINGLES)))
    counted = cuts.write(_screen(_spread_texts(known, buckets, size), buckets).groupBy("id").agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "digest")).alias("s"), F.sum("shared").alias("shared")).select("id", "s.n", "s.digest", "shared"))
    equal = counted.filter((F.col("n") > 0) & (100 * F.col("shared") >= percent * F.col("n"))).select("id", "n", "digest")
    reps = equal.groupBy("n", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("w"))
    reps = cuts.write(reps)
    wanted = broadcast_if_small(reps.select(F.col("rep").alias("id"), "digest"), reps.count(), 100)
    chunks = search.write(_chunks(_sets_of(known, wanted, size)))
    prefixes = search.write(_prefixes(chunks, _rarity(chunks, buckets), buckets, percent))
    islands = components(spark, candidate_links(search, prefixes, chunks, percent), search)
    regions = join.write(_unpacked(chunks).join(islands, F.col("id") == F.col("node")).select(F.col("component").alias("region"), "id", "set"))
    search.clear()
    comp = components(spark, metric_join(join, regions, percent), cuts)
    join.clear()
    member = equal.join(reps.filter("w > 1"), ["n", "digest"]).select("id", "rep").filter("id <> rep")  # copies of a representative
    out = (
        counted.select("id", "n").join(member, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
        .join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    )
    nameless = map_texts(rows.filter("id is null"), "id", "text", "n_shingles long", lambda ts: {"n_shingles": [len(shingle_set(t, size)) for t in ts]})
    return out.union(nameless.select(F.col("id").alias(id_col), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``id, set`` of the wanted documents: of rows that share an id the one with the wanted digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("id long, set binary")
        for whole in batches:
            for batch in slices(whole, 1):
                made = [(i, s.tobytes()) for i, t, d in zip(*(c.to_pylist() for c in batch.columns)) if xxhash.xxh3_128_digest((s := shingle_set(t, size)).tobytes()) == d]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int64()), pa.array([s for _, s in made], pa.binary())], schema=schema)

    return docs.join(wanted, "id").select("id", "text", "digest").mapInArrow(run, "id long, set binary").dropDuplicates(["id"])
