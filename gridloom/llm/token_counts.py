"""Token counts of whole texts; huge texts are encoded in overlapping chunks that resynchronise.

Method. A text longer than ``chunk_chars`` is cut into overlapping chunks, each encoded with offsets.
Two neighbours are spliced at a boundary that is provably stable: a position where a pre-token of the
left chunk ends before the chunk does and a pre-token of the right chunk begins, at least
``margin`` characters away from the cut ends. The pre-tokenizer scans forward without looking back, so
from a shared pre-token boundary on both scans agree with the scan of the whole text; the margin is
wider than any added token, so none can straddle a cut unseen. Where no such boundary exists, the
overlap doubles, until the rest of the text is one chunk.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results; columns
other than the id and the text are dropped, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from gridloom.llm.common import map_texts, n_bytes

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
_LOADED: dict[str, object] = {}


def load(path: str):
    """A tokenizer from its file, once per process, single-threaded: Spark's tasks are the parallelism."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _starts(encoding) -> dict[int, int]:
    """Character position of each pre-token (or added token) start -> index of its first token."""
    out: dict[int, int] = {}
    words, offsets, last = encoding.word_ids, encoding.offsets, object()
    specials = encoding.special_tokens_mask
    for k, (w, (a, b)) in enumerate(zip(words, offsets)):
        if w is None or w != last or specials[k]:
            out.setdefault(a, k)
        last = w
    return out


def chunked_ids(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = 64) -> list[int]:
    """Ids of the whole text from overlapping chunks; equal to encoding it at once."""
    encode = lambda s: tokenizer.encode(s, add_special_tokens=False)
    ids: list[int] = []
    begin, end = 0, chunk
    left, first = encode(text[:end]), 0  # of the left chunk, tokens from ``first`` on are still to be taken
    while end < len(text):
        a, width, splice = _starts(left), overlap, None
        while splice is None and end - width > begin + margin:
            start = end - width
            right = encode(text[start : start + chunk])
            b = _starts(right)
            stable = [p for p in b if margin <= p <= width - margin and a.get(p + start - begin, -1) >= first]
            if stable:
                splice = max(stable)
            else:
                width *= 2
        if splice is None:  # no boundary in all of the chunk: a longer chunk from the same start
            end += end - begin
            left = encode(text[begin:end])
            continue
        ids += left.ids[first : a[splice + start - begin]]
        begin, end, left, first = start, start + chunk, right, b[splice]
    return ids + left.ids[first:]


def count_batch(tokenizer, texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    out = [0] * len(texts)
    short = [k for k, t in enumerate(texts) if t and len(t) <= chunk]
    for at in range(0, len(short), 64):
        part = short[at : at + 64]
        for k, e in zip(part, tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)):
            out[k] = len(e)
    for k, t in enumerate(texts):
        if t and len(t) > chunk:
            out[k] = len(chunked_ids(tokenizer, t, chunk, overlap))
    return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` per row; ``vocabulary`` is the path of a tokenizers file on every executor."""

    def run(texts: list[str | None]) -> dict[str, list]:
        n = count_batch(load(vocabulary), texts, chunk, overlap)
        return {"n_bytes": [n_bytes(t) for t in texts], "n_tokens": n, "over_limit": [c > limit for c in n]}

    return map_texts(docs, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", run)
