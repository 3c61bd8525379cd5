r"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

Texts become ids word by word: the tokenizer's normalizer and pre-tokenizer treat what stands between two
spaces or line ends by itself (tested), so the ids of a word are kept and looked up again; new words of plain
letters, digits and signs are cut into pre-tokens here, which go straight to the model. A vocabulary with
another normalizer or pre-tokenizer encodes whole texts. An end id follows each document. Pieces of ``capacity`` ids are cut off as full windows; what is left of some thousand
documents is spread over windows at once: partial partitions, at first one piece each, are merged two at a
time, those with the largest spread first, the fullest window of one with the emptiest of the other, which
gives near-equal sums. The window count starts at the least possible and rises while a window exceeds
the capacity; where large pieces leave gaps, they are halved. A group too small to fill its windows (the end of a partition) first gives up a tail, cut into
windows of powers of two, which need no padding.

A task groups the rows it reads, so nothing is shuffled and no key gathers rows.

Edge cases: null and empty texts have the end id only; repeated rows and null ids are packed like any other
row; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import arrow_schema, slices
from gridloom.llm.token_counts import load

CAPACITY = 4096
GROUP_DOCS, GROUP_TOKENS = 2048, 1_200_000
CACHE_WORDS, CACHE_LENGTH = 600_000, 48
# The normalizer and the split of the vocabularies whose words can be encoded one by one.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that keep their length and place under lower-casing and composition, and signs but the apostrophe.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}{_SIGNS}0-9]+")
_PIECE = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each Latin-1 letter's UTF-8 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    sign = {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Known(dict):
    """Ids of words as little-endian 32-bit bytes, learned as they come up."""

    def __init__(self, tokenizer, older: dict[str, bytes] | None = None):
        super().__init__({"": b""})
        self.tokenizer, self.model, self.letters, self.pieces = tokenizer, tokenizer.model, _byte_letters(), {}
        self.older = older or {}  # what was known when this one began

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(word) <= CACHE_LENGTH:
            self[word] = ids
        return ids

    def learn(self, word: str) -> bytes:
        """A plain word goes by its pre-tokens straight to the model, any other through the whole tokenizer."""
        if word.isascii():
            if word.isalpha():
                return self.piece(word.lower())
            core, last = word[:-1], word[-1]
            if last in ".,;:!?" and core.isalpha():
                return self.piece(core.lower()) + self.piece(last)
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.piece, _PIECE.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]).tobytes()
            if len(piece) <= CACHE_LENGTH:
                self.pieces[piece] = ids
        return ids


class WordIds:
    """Little-endian 32-bit ids of texts, word by word where the vocabulary allows it."""

    def __init__(self, tokenizer, limit: int = CACHE_WORDS):
        self.limit = limit  # words kept, twice as many at most
        self.tokenizer, self.known = tokenizer, _Known(tokenizer)
        made = json.loads(tokenizer.to_str())
        normal, split = made["normalizer"] or {}, made["pre_tokenizer"] or {}
        self.by_word = [n["type"] for n in normal.get("normalizers", ())] == _NORMAL and [p.get("pattern") for p in split.get("pretokenizers", ())] == [{"Regex": _SPLIT}, None]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.known) > self.limit:
            self.known = _Known(self.tokenizer, dict(self.known))
        ids = self.known.__getitem__
        return [b"".join(map(ids, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]


_WORDS: dict[str, WordIds] = {}


def word_ids(vocabulary: str, limit: int) -> WordIds:
    """One per process: a worker's later tasks know the words of its earlier ones."""
    if vocabulary not in _WORDS:
        _WORDS[vocabulary] = WordIds(load(vocabulary), limit)
    return _WORDS[vocabulary]


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each piece: Karmarkar-Karp for ``windows`` parts."""
    if windows == 1 or not sizes:
        return np.zeros(len(sizes), int)
    nodes: list[tuple] = [(None, None, None)] * len(sizes)  # of inner nodes: two children and the order of their sums
    heap = []
    for k, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, k, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        total = x + y[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-int(total[0]), len(nodes) - 1, total))
    out = np.zeros(len(sizes), int)
    stack = [(len(nodes) - 1, np.arange(windows))]
    while stack:
        k, at = stack.pop()
        a, b, order = nodes[k]
        if a is None:
            out[k] = at[0]
            continue
        for child, place in ((a, order), (b, windows - 1 - order)):
            own = np.empty(windows, int)
            own[place] = at
            stack.append((child, own))
    return out


def spread(sizes: list[int], capacity: int) -> np.ndarray:
    """Windows of pieces, each at most ``capacity``; as few as differencing can fill."""
    total = sum(sizes)
    windows = max(1, -(-total // capacity))
    while True:
        at = differencing(sizes, windows)
        over = int(np.bincount(at, sizes, windows).max(initial=0)) - capacity
        if over <= 0:
            return at
        # so many that the fullest fits if it stays as far above the mean
        mean = total / windows - over
        windows = max(windows + 1, min(math.ceil(total / mean), windows + windows // 50 + 1) if mean > 0 else 0)


def pack(lengths: list[int], capacity: int = CAPACITY, dense: float = 0.99) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) of documents with so many ids."""
    sequences, pieces = [], []
    for doc, n in enumerate(lengths):
        full = n // capacity
        sequences += [[(doc, k * capacity, capacity)] for k in range(full)]
        if n % capacity:
            pieces.append((doc, full * capacity, n % capacity))
    total = sum(p[2] for p in pieces)
    windows = -(-total // capacity)
    if total and total < dense * windows * capacity:  # a tail goes to windows of powers of two
        keep = (windows - 1) * capacity
        tail = total - keep + (windows - 1) * (capacity // 512)
        tail = total if tail >= total else tail
        taken: list[tuple[int, int, int]] = []
        while tail:
            doc, start, n = pieces.pop()
            cut = min(n, tail)
            taken.append((doc, start + n - cut, cut))
            if cut < n:
                pieces.append((doc, start, n - cut))
            tail -= cut
        sequences += powers(taken)
    if pieces:
        least, size = -(-sum(p[2] for p in pieces) // capacity), capacity // 2
        at = spread([p[2] for p in pieces], capacity)
        while at.max() + 1 > 1.04 * least + 1 and size >= 64:  # large pieces leave gaps: halve them
            pieces = [q for doc, start, n in pieces for q in ([(doc, start, n // 2), (doc, start + n // 2, n - n // 2)] if n > size else [(doc, start, n)])]
            at, size = spread([p[2] for p in pieces], capacity), size // 2
        own: dict[int, list] = {}
        for w, p in zip(at.tolist(), pieces):
            own.setdefault(w, []).append(p)
        sequences += [own[w] for w in sorted(own)]
    return sequences


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces laid end to end and cut into sequences whose lengths are the powers of two in their sum."""
    total, out, k, used = sum(p[2] for p in pieces), [], 0, 0
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        room, own = 1 << bit, []
        while room:
            doc, start, n = pieces[k]
            cut = min(room, n - used)
            own.append((doc, start + used, cut))
            room, used = room - cut, used + cut
            if used == n:
                k, used = k + 1, 0
        out.append(own)
    return out


def packed(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", words_kept: int = CACHE_WORDS) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece; ``vocabulary``: a tokenizers file on every executor; ``words_kept`` bounds a worker's memory."""
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names)])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, words = arrow_schema(schema), word_ids(vocabulary, words_kept)
        next_id = TaskContext.get().partitionId() << 32
        held_ids: list[pa.Array] = []
        held: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            rows, doc_of = [], []
            for k, sequence in enumerate(pack([len(x) // 4 for x in held], capacity)):
                offset = 0
                for doc, start, n in sequence:
                    doc_of.append(doc)
                    rows.append((start, n, zlib.crc32(memoryview(held[doc])[4 * start : 4 * (start + n)]), len(held[doc]) // 4, next_id + k, offset))
                    offset += n
            next_id += len(rows)
            ids = pa.concat_arrays(held_ids).take(pa.array(doc_of, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.cast(arrow.field(0).type), *(pa.array(c, pa.int64()) for c in zip(*rows))], schema=arrow)
            held_ids.clear()
            held.clear()

        tokens = 0
        for whole in batches:
            for batch in slices(whole, 1, 1 << 21):
                taken = 0
                for at, ids in enumerate(words.encode(batch.column(1).to_pylist()), 1):
                    held.append(ids + end)
                    tokens += len(ids) // 4 + 1
                    if len(held) >= GROUP_DOCS or tokens >= GROUP_TOKENS:
                        held_ids.append(batch.column(0).slice(taken, at - taken))
                        yield from flush()
                        tokens, taken = 0, at
                held_ids.append(batch.column(0).slice(taken))
        if held:
            yield from flush()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
