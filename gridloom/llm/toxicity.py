r"""Toxicity from a weighted lexicon, matched by Aho-Corasick after folding.

Folding maps each character to one character: case, look-alike letters of other scripts, digits and
signs that stand for letters. Everything else that is not a letter becomes a space, so a pattern starts
with a space, and ends with one when it is a whole word; patterns without it are word beginnings.

Lexicon. Document frequencies of words and word beginnings in toxic and clean training texts give smoothed
log-odds weights; a beginning stands for its extensions when it is as pure as they are. Exception
phrases are word pairs with a lexicon word that clean training texts hold and toxic ones (almost) never
do, besides those a caller gives (none unless so); a hit inside an exception phrase doesn't count. A text's hits add up their
weights; the sum and the sum for each hundred words go through a logistic curve fitted to training texts.

Training uses at most ``sample`` labelled rows (the smallest hashes of their ids), whatever the table's
size, copies of a text once; scoring reads every whole text. Edge cases: null, empty and wordless texts have no hits and get the
curve's value at 0; rows without a label only lack training weight; conflicting labels of one id both
count; repeated rows repeat; other columns are dropped; without training rows every score is 0.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import Cuts, map_texts

# Characters that are drawn like a Latin letter, and digits and signs written for one.
LOOK_ALIKES = {
    "a": "аαɑ@4", "b": "ЬвβƄ8", "c": "сϲ", "d": "ԁ", "e": "еєε3€", "f": "ƒ", "g": "ɡ9", "h": "һ", "i": "іιı1!|", "j": "ј", "k": "кκ", "l": "ӏ",
    "m": "м", "n": "пη", "o": "оο0ө", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7+", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ×", "y": "уγ", "z": "ʐ",
}
PREFIXES = (4, 5, 6, 7)
SUPPORT = 5
TERMS_KEPT = 200_000  # in a task, before their counts go on
_WORD = re.compile(r"\S+")


class _Folding(dict):
    """A table for str.translate, filled as characters come up."""

    def __missing__(self, code: int) -> str:
        c = chr(code - 0xFEE0) if 0xFF01 <= code <= 0xFF5E else chr(code)
        low = c.lower()[:1]
        for latin, drawn in LOOK_ALIKES.items():
            if c in drawn or low in drawn or low in drawn.lower():
                low = latin
        self[code] = out = low if low.isalpha() else " "
        return out


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """One folded character for each character, between two spaces."""
    return f" {text.translate(_FOLDING)} " if text else "  "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: list[str] = field(default_factory=list)  # " word word "
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        exceptions = set(self.exceptions)
        for p in {*self.weights, *exceptions}:
            a.add_word(p, (len(p), self.weights.get(p, 0.0), p in exceptions))
        if len(a):
            a.make_automaton()
        return a


def measure(automaton, folded: str) -> tuple[float, float]:
    """The weight of the hits, and that weight for each hundred words."""
    if not len(automaton):
        return 0.0, 0.0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight, exception) in automaton.iter(folded):
        start = end - length + 1
        if exception:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared:  # of those that begin by ``s`` the one that reaches furthest decides
        spared.sort()
        starts, reach = [a for a, _ in spared], list(itertools.accumulate((b for _, b in spared), max))
        best = {s: w for s, w in best.items() if not (k := bisect.bisect_right(starts, s)) or reach[k - 1] <= s}
    total = sum(best.values())
    return total, 100.0 * total / max(20, len(folded.split())) if total else 0.0


def _terms(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return out


def _count(rows: DataFrame, text_col: str, pairs_of: frozenset[str] | None = None) -> DataFrame:
    """``term, bad, clean``: toxic and clean texts that hold each term (or each pair with a word of ``pairs_of``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}

        def out(toxic: int) -> pa.RecordBatch:
            c, found[toxic] = found[toxic], Counter()
            return pa.RecordBatch.from_pydict({"term": pa.array(list(c), pa.string()), "toxic": pa.array([toxic] * len(c), pa.int32()), "n": pa.array(list(c.values()), pa.int64())})

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                if pairs_of is not None:
                    ws = folded.split()
                    terms = {f" {a} {b} " for a, b in zip(ws, ws[1:]) if f" {a} " in pairs_of or f" {b} " in pairs_of}
                else:
                    terms = _terms(folded)
                found[toxic].update(terms)
                if len(found[toxic]) > TERMS_KEPT:
                    yield out(toxic)
        yield from map(out, (0, 1))

    n = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    return rows.select(text_col, "toxic").mapInArrow(run, "term string, toxic int, n long").groupBy("term").agg(n(1).alias("bad"), n(0).alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, ...]:
    """Newton's method with a small ridge; steps are halved until the loss falls, as parted classes make it overshoot."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 5e-4 * w @ w
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
        while np.abs(step).max() > 1e-9 and loss(w + step) >= now:
            step /= 2
        if np.abs(step).max() <= 1e-9:
            break
        w += step
        now = loss(w)
    return tuple(map(float, w))


def features(total: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(total), np.log1p(rate)])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled training rows. ``sample`` bounds the rows: the smallest hashes of their ids;
    a term needs ``support`` toxic texts among them, however many there are, and down to 3 where they are few."""
    spark = docs.sparkSession
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("l_id"), "l_id", "toxic").limit(sample)
    # at most ``sample`` rows of 12 bytes: broadcast
    rows = Cuts(spark).write(docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("l_id")).select(F.col(text_col).alias("text"), "toxic").distinct())
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Lexicon()
    odds = lambda a, b: math.log((a + 0.25) / (pos + 0.5)) - math.log((b + 0.25) / (neg + 0.5))
    ratio = (F.col("bad") + 0.25) / (pos + 0.5) / ((F.col("clean") + 0.25) / (neg + 0.5))
    least = min(support, max(3, math.ceil(0.02 * pos)))
    # only terms of the lexicon come here
    held, weights = {}, {}
    for r in _count(rows, "text").filter((F.col("bad") >= least) & (F.log(ratio) >= 2.5)).collect():
        held[r["term"]], weights[r["term"]] = r["bad"], odds(r["bad"], r["clean"])
    kept: dict[str, float] = {}
    for t in sorted(weights, key=lambda t: (len(t.rstrip()), t)):  # beginnings before what goes on from them
        shorter = [kept[t[:k]] for k in range(2, len(t.rstrip()) + 1) if t[:k] in kept and t[:k] != t]
        if not shorter or weights[t] > max(shorter) + 1.0:
            kept[t] = weights[t]
    # a beginning gives way to the whole word that makes up nearly all of it
    whole = sorted(t for t in weights if t.endswith(" "))
    for t in [t for t in kept if not t.endswith(" ")]:
        own = whole[bisect.bisect_left(whole, t) : bisect.bisect_left(whole, t + chr(0x10FFFF))]
        full = max(own, key=lambda w: (held[w], w), default=None)
        if full and held[full] >= 0.95 * held[t]:
            del kept[t]
            kept[full] = weights[full]
    words = frozenset(t for t in kept if t.endswith(" "))
    pairs = _count(rows, "text", words).filter("clean - 20 * bad >= 3").select("term").collect() if words else []
    spared = sorted({fold(p) for p in exceptions} | {r["term"] for r in pairs})
    lexicon = Lexicon(kept, spared)
    xs = _measured(rows, "text", "toxic", lexicon).collect()  # ``sample`` rows of three numbers at most
    y = np.array([r["key"] for r in xs], float)
    w = _logistic(features(np.array([r["total"] for r in xs]), np.array([r["rate"] for r in xs])), y)
    lexicon.curve = w
    return lexicon


def _measured(rows: DataFrame, text_col: str, key: str, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            m = [measure(automaton, fold(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": batch.column(1), "total": pa.array([a for a, _ in m], pa.float64()), "rate": pa.array([b for _, b in m], pa.float64())})

    return rows.select(F.col(text_col), F.col(key).alias("key")).mapInArrow(run, T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("total", T.DoubleType()), T.StructField("rate", T.DoubleType())]))


def scores(lexicon: Lexicon, automaton, texts: list[str | None]) -> np.ndarray:
    m = np.array([measure(automaton, fold(t)) for t in texts], float).reshape(-1, 2)
    z = lexicon.curve[0] + features(m[:, 0], m[:, 1]) @ np.array(lexicon.curve[1:])
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` per row."""

    def run(texts: list[str | None]) -> dict:
        s = scores(lexicon, _automaton(lexicon), texts)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_texts(docs, id_col, text_col, "score double, predicted int", run)


_BUILT: dict = {}


def _automaton(lexicon: Lexicon):
    """Built once per process and lexicon."""
    key = (len(lexicon.weights), tuple(lexicon.curve), tuple(sorted(lexicon.weights)[:50]))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = lexicon.automaton()
    return _BUILT[key]
