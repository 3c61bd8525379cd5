r"""Removal of long repeated strings, from sparse suffix arrays in a logarithmic index family.

A text is a string of symbols: its UTF-8 bytes, or (``words=True``) its words as 32-bit hashes, laid end to
end. Whatever a string of ``length`` symbols covers that also starts anywhere else goes. Every window of that
length has one anchor: the leftmost smallest hash of its substrings of ``gram`` symbols. Equal windows have
equal anchors at equal offsets, so only the suffixes at anchors are indexed, each with its hull (all
windows that the anchor stands for).

1. Hulls are counted by anchor and hull hash, combined before the shuffle. Equal hulls make a class, which
   two of its occurrences (or its only one) stand for. Anchors that occur once are done.
2. The bytes of those are fetched and dealt out by anchor. A task takes them in batches. Each batch gets
   two suffix arrays (text right of the anchors; text left of them, reversed) with longest common prefixes,
   is merge-scanned against each existing level, and equal-sized levels merge, so an entry is merged a
   logarithmic number of times. A scan finds, offset by offset, which windows share the class of both
   arrays at the lengths they need; the outermost ones give the class's repeated interval.
3. An anchor with more than ``hot`` entries is dealt out further: windows whose offsets lie in one
   segment share their core (the part common to all of them), so their hulls go by anchor, segment and core to
   tasks of their own, indexed in the same way; segments shrink (``STEPS``) down to single windows, which
   are all equal under one core, so no task ever holds more than ``hot`` different entries of one key.
4. A class's interval goes to all its occurrences, and documents drop what their intervals cover.

Edge cases: null text counts as empty; texts shorter than ``length`` keep everything; repeated rows repeat
each other; ids may be null or shared (rows are told apart by id and text together, 128 bits of hash); an
empty table gives an empty result; all columns of the input come back, whatever their names. Equal hulls are told
by 128 bits of hash of anchor and hull.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import Cuts, arrow_schema, slices, small_batches
from gridloom.llm.shingles import mix

LENGTH, GRAM = 400, 80
SLICE = 1 << 20  # bytes looked at together
BATCH, CHUNK, HOT = 1024, 16384, 4096
STEPS = (32, 4, 1)  # offsets in a segment of a hot anchor
WORD = re.compile(rb"[^\x20\t-\r]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_ANCHOR = "h long, ch long, r1 long, r2 long, pos long, lo int, hi int"
_POWERS: list[np.ndarray] = []
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _WordBytes(dict):
    """Four bytes for each word."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh32_digest(word)
        return value


_WORD_BYTES = _WordBytes()


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def symbols(raw: bytes, words: bool) -> bytes:
    """What windows are cut from: the bytes themselves, or four for each word."""
    return b"".join(map(_WORD_BYTES.__getitem__, WORD.findall(raw))) if words else raw


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(max(n, SLICE + LENGTH), _BASE, np.uint64), np.full(max(n, SLICE + LENGTH), pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes, by prefix sums of a polynomial modulo 2**64."""
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[data] * up, out=total[1:])
    h = total[gram:] - total[:-gram]
    h *= down[: len(h)]
    return mix(h)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: (text, position in data, lowest and highest offset, hash of the gram).

    ``bounds`` are the texts' starts and the end. A window that starts at p has the anchor p + offset.
    """
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    if len(data) < length:
        return none
    assert len(data) <= 1 << 24  # positions have 24 bits
    w = length - gram + 1
    h = gram_hashes(data, gram)
    packed = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    count = len(h) - w + 1
    rows = -(-len(h) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(h)] = packed
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    # runs of windows with one anchor, inside one text
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    ends = np.r_[starts[1:], count] - 1
    first_text = np.searchsorted(bounds, starts, side="right") - 1
    last_text = np.searchsorted(bounds, ends, side="right") - 1
    out = []
    simple = (first_text == last_text) & (ends + length <= bounds[first_text + 1])
    out.append((first_text[simple], at[starts[simple]], starts[simple], ends[simple]))
    for k in np.flatnonzero(~simple):  # runs over the ends of texts
        for t in range(first_text[k], last_text[k] + 1):
            lo, hi = max(starts[k], bounds[t]), min(ends[k], bounds[t + 1] - length)
            if lo <= hi:
                out.append(tuple(np.array([x]) for x in (t, at[starts[k]], lo, hi)))
    text, pos, first, last = (np.concatenate(c) for c in zip(*out))
    return text, pos, pos - last, pos - first, h[pos]


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int = LENGTH, gram: int = GRAM, words: bool = False, piece: int = SLICE) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_ANCHOR)
    for whole in batches:
        for batch in slices(whole, 2, piece):
            r1, r2 = (np.asarray(batch.column(k)) for k in (0, 1))
            texts = [symbols(utf8(t), words) for t in batch.column(2).to_pylist()]
            # huge texts in pieces, by themselves
            step = piece - length + 1
            small = [k for k, t in enumerate(texts) if len(t) <= 2 * piece]
            pieces = [([texts[k] for k in small], np.array(small, int), 0)]
            pieces += [([t[at : at + piece]], np.array([k]), at) for k, t in enumerate(texts) if len(t) > 2 * piece for at in range(0, len(t) - length + 1, step)]
            for part, own, shift in pieces:
                raw = b"".join(part)
                bounds = np.cumsum([0, *map(len, part)])
                text, pos, lo, hi, h = anchors(np.frombuffer(raw, np.uint8), bounds, length, gram)
                if not len(text):
                    continue
                ch = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((pos - hi).tolist(), (pos + length - lo).tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(r1[own[text]]), pa.array(r2[own[text]]), pa.array(pos - bounds[text] + shift), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], schema=schema)


# -- the index family -------------------------------------------------------------------------------


@dataclass
class Level:
    """Entries in two suffix-array orders with the common prefixes of neighbours."""

    length: int  # of a window
    entry: np.ndarray  # numbers of the entries
    right: np.ndarray  # sorted keys (group, text right of the anchor)
    right_of: np.ndarray  # entry index (into ``entry``) at each place
    right_lcp: np.ndarray
    left: np.ndarray
    left_of: np.ndarray
    left_lcp: np.ndarray


def _lcp(keys: np.ndarray) -> np.ndarray:
    """Common bytes of each key with the one before, less the eight of the group; -1 across groups and first."""
    if len(keys) < 2:
        return np.full(len(keys), -1)
    m = keys.view(np.uint8).reshape(len(keys), -1)
    differ = m[1:] != m[:-1]
    at = differ.argmax(axis=1)
    at[~differ.any(axis=1)] = m.shape[1]
    return np.r_[-1, np.where(at < 8, -1, at - 8)]


def _keys(groups: np.ndarray, parts: list[bytes], width: int) -> np.ndarray:
    raw = b"".join(g + p.ljust(width, b"\0") for g, p in zip((int(x).to_bytes(8, "big") for x in groups), parts))
    return np.frombuffer(raw, f"S{width + 8}")


def build(length: int, entry: np.ndarray, groups: np.ndarray, right: list[bytes], left: list[bytes]) -> Level:
    a, b = _keys(groups, right, length), _keys(groups, left, length)
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[i], b[j]
    return Level(length, entry, a, i, _lcp(a), b, j, _lcp(b))


def merge(x: Level, y: Level) -> Level:
    """Two levels as one; the stable sort of two sorted runs is a merge."""
    a, b = np.concatenate([x.right, y.right]), np.concatenate([x.left, y.left])
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    ro, lo = np.concatenate([x.right_of, y.right_of + len(x.entry)])[i], np.concatenate([x.left_of, y.left_of + len(x.entry)])[j]
    return Level(x.length, np.concatenate([x.entry, y.entry]), a[i], ro, _lcp(a[i]), b[j], lo, _lcp(b[j]))


def scan(level: Level, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
    """Widen ``least`` and ``most`` (by entry number) to the offsets whose windows occur twice in the level."""
    n = len(level.entry)
    if n < 2:
        return
    low, high = lo[level.entry], hi[level.entry]
    for o in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[level.right_of] = np.cumsum(level.right_lcp < level.length - o)
        left[level.left_of] = np.cumsum(level.left_lcp < o)
        key = left[own] * (n + 1) + right[own]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        e = level.entry[own[twice]]
        least[e] = np.minimum(least[e], o)
        most[e] = np.maximum(most[e], o)


def subset(level: Level, keep: np.ndarray) -> Level:
    """The entries at the places of ``keep`` (a mask over ``entry``)."""
    new = np.cumsum(keep) - 1
    r, l = keep[level.right_of], keep[level.left_of]
    a, b = level.right[r], level.left[l]
    return Level(level.length, level.entry[keep], a, new[level.right_of[r]], _lcp(a), b, new[level.left_of[l]], _lcp(b))


class IndexFamily:
    """Levels of doubling size over the entries given so far, and the repeated offsets of each entry."""

    def __init__(self, groups: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH):
        self.groups, self.lo, self.hi, self.length = groups, lo, hi, length
        self.least, self.most = np.full(len(lo), 1 << 30), np.full(len(lo), -1)
        self.levels: list[Level] = []

    def add(self, entry: np.ndarray, right: list[bytes], left: list[bytes]) -> None:
        new = build(self.length, entry, self.groups[entry], right, left)
        scan(new, self.lo, self.hi, self.least, self.most)
        for level in self.levels:  # only groups on both sides can match
            mine, theirs = self.groups[new.entry], self.groups[level.entry]
            a, b = np.isin(mine, theirs), np.isin(theirs, mine)
            if a.any():
                scan(merge(subset(new, a), subset(level, b)), self.lo, self.hi, self.least, self.most)
        while self.levels and len(self.levels[-1].entry) <= len(new.entry):
            new = merge(self.levels.pop(), new)
        self.levels.append(new)


def repeated_offsets(groups: np.ndarray, lo: np.ndarray, hi: np.ndarray, hulls: list[bytes], batch: int = BATCH, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest repeated offset of each entry (lowest > highest: none)."""
    family = IndexFamily(groups, lo, hi, length)
    for at in range(0, len(hulls), batch):
        entry = np.arange(at, min(at + batch, len(hulls)))
        right = [hulls[k][hi[k] :] for k in entry]
        left = [hulls[k][: hi[k]][::-1] for k in entry]
        family.add(entry, right, left)
    return family.least, family.most


#: A group ``g`` of hulls around an equal anchor (or core), a class ``c`` of equal ones, and which of them this is.
_ENTRY = "g long, c long, r1 long, r2 long, pos long, twin int, v long, lo int, hi int, hull binary"
_CLASS = "g long, c long, least int, most int"
_SEGMENT = "h long, ch long, g long, c long, lo int, hi int, hull binary"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _entry_chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[list[tuple]]:
    """Different entries sorted by group, cut between groups. What equal rows fetched more than once counts once."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[:6] == rows[-1][:6]:
                continue
            if len(rows) >= chunk and row[0] != rows[-1][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _index(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for rows in _entry_chunks(batches, CHUNK):
        g, c, _, _, _, twin, _, lo, hi, hulls = zip(*rows)
        lo, hi = np.array(lo), np.array(hi)
        least, most = repeated_offsets(np.unique(np.array(g), return_inverse=True)[1], lo, hi, list(hulls), length=length)
        out = [(a, b, x, y) for a, b, x, y, t in zip(g, c, least.tolist(), most.tolist(), twin) if y >= x and not t]
        if out:
            yield _batch(out, _CLASS)


def _segments(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    """Hulls cut by segments of ``step`` offsets, grouped by what all windows of the segment share."""
    for batch in batches:
        for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            out = []
            for h, ch, lo, hi, hull in zip(*(c.to_pylist() for c in part.columns)):
                for a in range(lo - lo % step, hi + 1, step):
                    b = a + step - 1
                    x, y = max(a, lo), min(b, hi)
                    own = hull[hi - y : hi - x + length]
                    core = hull[hi - a : hi - b + length]
                    out.append((h, ch, xxhash.xxh3_64_intdigest(core, a) - (1 << 63), xxhash.xxh3_64_intdigest(own, x << 20 | y) - (1 << 63), x, y, own))
            if out:
                yield _batch(out, _SEGMENT)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns) and two hashes of id and text that name the row."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    i = F.col(id_col).cast("string")
    return docs.select(F.struct("*").alias("row"), F.xxhash64(i, t).alias("r1"), F.xxhash64(t, F.lit(7), i).alias("r2"))


def _stand_ins(classes: DataFrame, kinds: DataFrame, group: str, *columns: str) -> DataFrame:
    """Two occurrences of each class of several, the only one of others, in groups with more than one."""
    twins = F.when(F.col("n") > 1, F.array(F.struct("one.*", F.lit(0).alias("twin")), F.struct("two.*", F.lit(1).alias("twin")))).otherwise(F.array(F.struct("one.*", F.lit(0).alias("twin"))))
    return classes.join(kinds, group).select(group, "v", *columns, F.explode(twins).alias("o")).select(group, "v", *columns, "o.*")


def _kinds(classes: DataFrame, group: str) -> DataFrame:
    return classes.groupBy(group).agg(F.sum(F.least(F.col("n"), F.lit(2))).alias("v"), F.sum("n").alias("total")).filter("total > 1").drop("total")


def _indexed(entries: DataFrame, length: int) -> DataFrame:
    names = [f.split()[0] for f in _ENTRY.split(", ")]
    return entries.select(names).repartition("g").sortWithinPartitions(*names[:6]).mapInArrow(partial(_index, length=length), _CLASS)


def repeated_intervals(cuts: Cuts, rows: DataFrame, text: F.Column, length: int, gram: int, words: bool, hot: int = HOT, piece: int = SLICE) -> DataFrame:
    """``r1, r2, s, e``: intervals of symbols' bytes that repeated strings cover; they may overlap."""
    texts = rows.select("r1", "r2", text.alias("t"))
    found = cuts.write(texts.mapInArrow(partial(_anchor_rows, length=length, gram=gram, words=words, piece=piece), _ANCHOR))
    where = F.struct("r1", "r2", "pos")
    hulls = found.groupBy("h", "ch", "lo", "hi").agg(F.count("*").alias("n"), F.min(where).alias("one"), F.max(where).alias("two"))
    wanted = _stand_ins(hulls, _kinds(hulls, "h"), "h", "ch", "lo", "hi").withColumnsRenamed({"h": "g", "ch": "c"})
    entries = cuts.write(_fetch(texts, wanted, length, words))
    hits = _indexed(entries.filter(F.col("v") <= hot), length).withColumnsRenamed({"g": "h", "c": "ch"})
    warm = entries.filter(F.col("v") > hot).select(F.col("g").alias("h"), F.col("c").alias("ch"), "lo", "hi", "hull")
    if not warm.isEmpty():
        for step in STEPS:
            parts = cuts.write(warm.mapInArrow(partial(_segments, length=length, step=step), _SEGMENT))
            own = F.struct(F.col("h").alias("r1"), F.col("ch").alias("r2"), F.lit(0).cast("long").alias("pos"), "hull")
            classes = parts.groupBy("g", "c", "lo", "hi").agg(F.count("*").alias("n"), F.min(own).alias("one"), F.max(own).alias("two"))
            kinds = cuts.write(_kinds(classes, "g"))
            last = step == STEPS[-1]  # every hull is one window, equal to all others of its core
            cool = cuts.write(_stand_ins(classes, kinds if last else kinds.filter(F.col("v") <= hot), "g", "c", "lo", "hi"))
            hits = hits.unionByName(parts.join(_indexed(cool, length), ["g", "c"]).select("h", "ch", "least", "most"))
            warm = parts.join(kinds.filter(F.col("v") > hot).select("g"), "g").select("h", "ch", "lo", "hi", "hull")
            if last or warm.isEmpty():
                break
    return found.join(cuts.write(hits), ["h", "ch"]).select("r1", "r2", (F.col("pos") - F.col("most")).alias("s"), (F.col("pos") + length - F.col("least")).alias("e"))


def _fetch(texts: DataFrame, wanted: DataFrame, length: int, words: bool) -> DataFrame:
    """The hull's bytes of each wanted anchor."""
    asked = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("g", "c", "pos", "twin", "v", "lo", "hi")).alias("asked"))  # bounded by the text's own length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for whole in batches:
            for batch in slices(whole, 2):
                out = []
                for r1, r2, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                    if (r1, r2) == before:  # an equal row has the same bytes
                        continue
                    before, raw = (r1, r2), symbols(utf8(text), words)
                    out += [(a["g"], a["c"], r1, r2, a["pos"], a["twin"], a["v"], a["lo"], a["hi"], raw[a["pos"] - a["hi"] : a["pos"] + length - a["lo"]]) for a in asked]
                if out:
                    yield _batch(out, _ENTRY)

    return texts.join(asked, ["r1", "r2"]).select("r1", "r2", "t", "asked").mapInArrow(run, _ENTRY)


def kept_bytes(raw: bytes, intervals: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, in how many maximal runs."""
    out, at, runs, removed, reach = [], 0, 0, 0, -1
    for s, e in sorted(intervals):
        if s > reach:
            runs += 1
            out.append(raw[at:s])
        removed += max(0, e - max(s, reach if reach >= 0 else s))
        reach = max(reach, e)
        at = reach
    out.append(raw[max(at, 0) :])
    return b"".join(out), removed, runs


def word_intervals(raw: bytes, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals of words' hashes as intervals of the text's bytes, from whole word to whole word."""
    if not intervals:
        return []
    places = [m.span() for m in WORD.finditer(raw)]
    return [(places[-(-s // 4)][0], places[e // 4 - 1][1]) for s, e in intervals]


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: bool = False, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", piece: int = SLICE) -> DataFrame:
    """``row`` (the input's columns), ``n_bytes, n_removed, n_spans, kept_sha256, kept_text``.

    ``length`` and ``gram`` count bytes, or words with ``words``. All occurrences of a repeat go.
    ``kept_text`` is what remains as text; characters that lost some of their bytes are left out of it.
    """
    if words:
        length, gram = 4 * length, 4 * gram
    small_batches(docs.sparkSession)
    cuts = Cuts(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    covered = repeated_intervals(cuts, rows, text, length, gram, words, hot, piece)
    spans = covered.groupBy("r1", "r2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # a set, as equal rows share it: bounded by the text's own length
    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    joined = rows.join(spans, ["r1", "r2"], "left").select("row", text.alias("t"), "spans")
    out_type = T.StructType([joined.schema["row"], *T.StructType.fromDDL(ddl).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out_type)
        for whole in batches:
            for batch in slices(whole, 1):
                made = []
                for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    raw, own = utf8(text), [(x["s"], x["e"]) for x in spans or ()]
                    kept, removed, runs = kept_bytes(raw, word_intervals(raw, own) if words else own)
                    made.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), *(pa.array(list(c), f.type) for c, f in zip(zip(*made), list(schema)[1:]))], schema=schema)

    return joined.mapInArrow(run, out_type)
