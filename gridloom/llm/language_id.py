r"""Language identification by a bidirectional gated recurrent network over bytes.

Training (numpy, back-propagation through time, Adam) runs on the driver over windows of ``WINDOW`` bytes. The
executors draw them, ``DRAWN`` from anywhere in each of at most ``sample`` labelled texts (the smallest
hashes of their ids), so what comes to the driver is bounded in bytes. Each direction reads byte embeddings
folded into its input weights; every position gets a probability for each language from both hidden
states, and a document's probabilities are the mean over all its positions.

Prediction reads every byte of every whole text, in segments of ``SEGMENT`` bytes that start afresh.
Edge cases: null, empty texts and texts without a letter give ``und`` with score 0; when there is nothing to learn
from, every text does; texts are their UTF-8 bytes; repeated rows repeat; other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import map_texts, slices

SEGMENT = 128
HIDDEN = 8
WINDOW, DRAWN = 48, 16
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    langs: list[str]
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def new_weights(n_langs: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in ("f", "b"):
        w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2 * hidden))
        w[f"c{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden))
        w[f"x{d}"][:, :hidden] += 1.0  # update gates start by keeping the state
    w["out"] = rng.normal(0, 0.3, (2 * hidden, n_langs))
    w["bias"] = np.zeros(n_langs)
    return {k: v.astype(np.float32) for k, v in w.items()}


def flipped(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(steps, rows, ...) with each row's first ``lengths`` steps in reverse, so that padding stays behind; its own inverse."""
    if (lengths == len(x)).all():
        return x[::-1]
    at = np.arange(len(x))[:, None]
    at = np.where(at < lengths, lengths - 1 - at, at)
    return np.take_along_axis(x, at.reshape(at.shape + (1,) * (x.ndim - 2)), axis=0)


def _direction(w: dict[str, np.ndarray], d: str, seq: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Hidden states of one direction, (steps, rows, hidden); seq: (steps, rows) bytes in reading order."""
    steps, rows = seq.shape
    u, c = w[f"u{d}"], w[f"c{d}"]
    x_all = w[f"x{d}"]
    k = u.shape[0]
    h = np.zeros((rows, k), u.dtype)
    out = np.empty((steps, rows, k), u.dtype)
    half = u.dtype.type(0.5)
    for t in range(steps):
        x = x_all.take(seq[t], axis=0)
        g = h @ u
        g += x[:, : 2 * k]
        g *= half
        np.tanh(g, out=g)
        g *= half
        g += half
        z, r = g[:, :k], g[:, k:]
        n = (r * h) @ c
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n  # z * h + (1 - z) * n
        if tape is not None:
            tape.append((h, z.copy(), r.copy(), n))
        out[t] = new
        h = new
    return out


def _back(w: dict[str, np.ndarray], d: str, seq: np.ndarray, tape: list, dh_out: np.ndarray, grads: dict[str, np.ndarray]) -> None:
    u, c = w[f"u{d}"], w[f"c{d}"]
    k = u.shape[0]
    gx, gu, gc = np.zeros_like(w[f"x{d}"]), np.zeros_like(u), np.zeros_like(c)
    carry = np.zeros_like(dh_out[0])
    for t in range(len(seq) - 1, -1, -1):
        h, z, r, n = tape[t]
        dh = dh_out[t] + carry
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        drh = dn @ c.T
        dr = drh * h * r * (1 - r)
        gate = np.concatenate([dz, dr], axis=1)
        gc += (r * h).T @ dn
        gu += h.T @ gate
        np.add.at(gx, seq[t], np.concatenate([gate, dn], axis=1))
        carry = dh * z + drh * r + gate @ u.T
    grads[f"x{d}"], grads[f"u{d}"], grads[f"c{d}"] = gx, gu, gc


def loss_and_grads(w: dict[str, np.ndarray], seq: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions of ``mask`` (steps, rows, 1) and its gradients."""
    hidden, rows, lengths = w["cf"].shape[0], np.arange(seq.shape[1]), mask[:, :, 0].sum(axis=0).astype(int)
    back = flipped(seq, lengths)
    tape_f: list = []
    tape_b: list = []
    hf = _direction(w, "f", seq, tape_f)
    hb = flipped(_direction(w, "b", back, tape_b), lengths)
    both = np.concatenate([hf, hb], axis=2)
    logits = both @ w["out"] + w["bias"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    loss = -float((np.log(p[:, rows, y]) * mask[:, :, 0]).sum() / mask.sum())
    p[:, rows, y] -= 1
    p *= mask / mask.sum()
    flat = p.reshape(-1, len(w["bias"]))
    grads = {"out": both.reshape(-1, 2 * hidden).T @ flat, "bias": flat.sum(axis=0)}
    d_both = p @ w["out"].T
    _back(w, "f", seq, tape_f, d_both[:, :, :hidden], grads)
    _back(w, "b", back, tape_b, flipped(d_both[:, :, hidden:], lengths), grads)
    return loss, grads


def fit(windows: list[bytes], langs: list[str], hidden: int = HIDDEN, steps: int = 350, rows: int = 128, seed: int = 7) -> Model:
    """Back-propagation through time over windows, languages drawn alike; positions of padding carry no loss."""
    names = sorted(set(langs))
    if not names:
        return Model([], {})
    rng = np.random.default_rng(seed)
    data = [np.frombuffer(t, np.uint8) for t in windows]
    length = max(1, *map(len, data))
    by = [[k for k, l in enumerate(langs) if l == name and len(data[k])] for name in names]
    by_names = [k for k, own in enumerate(by) if own]
    w = new_weights(len(names), hidden, rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    for step in range(1, steps + 1) if by_names else ():
        y = rng.choice(by_names, rows)
        seq, mask = np.zeros((length, rows), np.uint8), np.zeros((length, rows, 1), np.float32)
        for j, label in enumerate(y):
            part = data[by[label][rng.integers(len(by[label]))]]
            seq[: len(part), j], mask[: len(part), j] = part, 1
        _, grads = loss_and_grads(w, seq, mask, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(names, w)


def position_sums(model: Model, data: np.ndarray, lengths: np.ndarray, block: int = 2048) -> np.ndarray:
    """For each segment the sum over its positions of the languages' probabilities; data: (segments, SEGMENT)."""
    out = np.zeros((len(data), len(model.langs)), np.float32)
    w = model.weights
    order = np.argsort(lengths, kind="stable")
    hidden = w["cf"].shape[0]
    for at in range(0, len(data), block):
        rows = order[at : at + block]
        steps = int(lengths[rows].max(initial=0))
        if not steps:
            continue
        seq = np.ascontiguousarray(data[rows, :steps].T)
        hf = _direction(w, "f", seq)
        hb = flipped(_direction(w, "b", flipped(seq, lengths[rows])), lengths[rows])
        logits = hf.reshape(-1, hidden) @ w["out"][:hidden]
        logits += hb.reshape(-1, hidden) @ w["out"][hidden:]
        logits += w["bias"]
        np.exp(logits, out=logits)
        logits /= logits @ np.ones((logits.shape[1], 1), np.float32)
        p = logits.reshape(steps, len(rows), -1)
        short = lengths[rows] < steps
        if short.any():
            p *= (np.arange(steps)[:, None] < lengths[rows][None, :])[:, :, None]
        out[rows] = p.sum(axis=0)
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    live = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if model.langs else []
    if not live:
        return langs, scores
    raw = [texts[k].encode("utf-8", "replace") for k in live]
    parts = [-(-len(r) // SEGMENT) for r in raw]
    data = np.frombuffer(b"".join(r.ljust(n * SEGMENT, b"\0") for r, n in zip(raw, parts)), np.uint8).reshape(-1, SEGMENT)
    first = np.cumsum([0, *parts[:-1]])
    size = np.full(len(data), SEGMENT)
    size[first + parts - 1] = [len(r) - (n - 1) * SEGMENT for r, n in zip(raw, parts)]
    sums = np.add.reduceat(position_sums(model, data, size), first, axis=0)
    for k, r, s in zip(live, raw, sums):
        best = int(s.argmax())
        langs[k], scores[k] = model.langs[best], float(min(1.0, s[best] / len(r)))
    return langs, scores


def windows_of(raw: bytes, seed: int, count: int = DRAWN, length: int = WINDOW) -> list[bytes]:
    """Windows from anywhere in a text, the same ones for the same seed; a short text whole."""
    if len(raw) <= length:
        return [raw] if raw else []
    return [raw[at : at + length] for at in np.random.default_rng(seed).integers(0, len(raw) - length + 1, count).tolist()]


def train(docs: DataFrame, sample: int = 4_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """Fits on windows of at most ``sample`` labelled rows, the smallest hashes of their ids."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    chosen = labelled.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                seeds, langs, ids, texts = (c.to_pylist() for c in batch.columns)
                drawn = [windows_of(t.encode("utf-8", "replace"), s & 0xFFFFFFFF) for s, t in zip(seeds, texts)]
                yield pa.RecordBatch.from_pydict({"id": batch.column(2), "lang": batch.column(1), "windows": pa.array(drawn, pa.list_(pa.binary()))})

    # at most ``sample`` ids: broadcast; then one text's windows for each
    own = labelled.join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("seed"), "lang", "id", "text")
    made = own.mapInArrow(draw, T.StructType([own.schema["id"], T.StructField("lang", T.StringType()), T.StructField("windows", T.ArrayType(T.BinaryType()))]))
    rows = made.groupBy("id").agg(F.min(F.struct("lang", "windows")).alias("r")).select("id", "r.*").orderBy("id").collect()
    pairs = [(bytes(x), r["lang"]) for r in rows for x in r["windows"]]
    return fit([x for x, _ in pairs], [l for _, l in pairs], **options)


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` per row."""

    def run(texts: list[str | None]) -> dict:
        langs, scores = predict(model, texts)
        return {"lang_pred": langs, "score": scores}

    return map_texts(docs, id_col, text_col, "lang_pred string, score double", run)
