"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of WINDOW bytes (A-Z lower-cased), which cover every byte. A forward and a backward gated
recurrent layer read each window; every position gets a distribution over the learned languages, and a document's
probabilities are the mean over all its positions. Training is backpropagation through time with Adam on windows drawn
from a bounded sample of labelled rows: about ``per_lang`` documents of every language (fewer where that came to more than
``most_docs`` in all), chosen by a hash of the id, and ``per_doc`` windows of each. Prediction reads whole texts, of any
length, and nothing but them.

Null texts and texts without a letter: ``und`` with score 0. No labelled rows: ``und`` everywhere. Rows with a null
label teach nothing. Ties go to the language that sorts first. Repeated rows get equal results; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

WINDOW = 64
HIDDEN = 16
BATCH = 2048
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Layer:
    """Byte inputs ``e`` (256, 3H: update, reset, candidate) and recurrent weights ``u`` (H, 3H)."""

    e: np.ndarray
    u: np.ndarray


@dataclass
class Model:
    layers: list[Layer]
    w: np.ndarray  # (2H, C)
    b: np.ndarray
    langs: list[str]


def _run(layer: Layer, bytes_: np.ndarray, mask: np.ndarray, backward: bool) -> list[tuple]:
    """Training pass over (B, T): the values that the backward pass needs, by step in reading order."""
    size = layer.u.shape[0]
    h = np.zeros((len(bytes_), size), np.float32)
    kept = []
    for t in range(bytes_.shape[1])[:: -1 if backward else 1]:
        x, g = layer.e[bytes_[:, t]], h @ layer.u
        z = _sigmoid(x[:, :size] + g[:, :size])
        r = _sigmoid(x[:, size : 2 * size] + g[:, size : 2 * size])
        n = np.tanh(x[:, 2 * size :] + r * g[:, 2 * size :])
        m = mask[:, t : t + 1]
        after = m * (n + z * (h - n))
        kept.append((t, h, z, r, n, g[:, 2 * size :], m, after))
        h = after
    return kept


def _back(layer: Layer, bytes_: np.ndarray, kept: list[tuple], grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``e`` and ``u`` from those of the states (T, B, H), through time."""
    size = layer.u.shape[0]
    de, du, carry = np.zeros_like(layer.e), np.zeros_like(layer.u), 0
    for t, h, z, r, n, gn, m, _ in reversed(kept):
        d = (grad[t] + carry) * m
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dx = np.concatenate([dz, dr, dn], axis=1)
        dg = np.concatenate([dz, dr, dn * r], axis=1)
        order = np.argsort(bytes_[:, t], kind="stable")
        b = bytes_[order, t]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        de[b[first]] += np.add.reduceat(dx[order], first, axis=0)
        du += h.T @ dg
        carry = d * z + dg @ layer.u.T
    return de, du


def gradients(params: list[np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients, by backpropagation through time, of the weighted cross-entropy of all positions of windows (B, T)."""
    layers, (w, b) = [Layer(params[0], params[1]), Layer(params[2], params[3])], params[4:]
    size = params[1].shape[0]
    runs = [_run(layers[0], x, mask, False), _run(layers[1], x, mask, True)]
    h = np.zeros((x.shape[1], len(x), 2 * size), w.dtype)
    for k, kept in enumerate(runs):
        for t, *_, after in kept:
            h[t, :, k * size : (k + 1) * size] = after
    logit = h @ w + b
    p = np.exp(logit - logit.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    p[:, np.arange(len(x)), y] -= 1
    p *= (mask.T * weight / max(mask.sum(), 1))[:, :, None]
    flat, states = p.reshape(-1, len(b)), h.reshape(-1, 2 * size)
    dh = p @ w.T
    return [*_back(layers[0], x, runs[0], dh[:, :, :size]), *_back(layers[1], x, runs[1], dh[:, :, size:]), states.T @ flat, flat.sum(axis=0)]


def train(windows: list[bytes], labels: list[str], epochs: int = 3, batch: int = 256, rate: float = 0.01, least_steps: int = 400, seed: int = 7) -> Model:
    rng = np.random.Generator(np.random.PCG64(seed))
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    x = np.zeros((len(windows), WINDOW), np.uint8)
    mask = np.zeros((len(windows), WINDOW), np.float32)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
        mask[i, : len(w)] = 1
    weight = 1 / np.maximum(np.bincount(y, minlength=len(langs)), 1)
    weight = (weight / weight.mean()).astype(np.float32)
    size = HIDDEN
    layers = [Layer(rng.normal(0, 0.3, (256, 3 * size)).astype(np.float32), rng.normal(0, size**-0.5, (size, 3 * size)).astype(np.float32)) for _ in range(2)]
    w, b = rng.normal(0, 0.3, (2 * size, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    params = [layers[0].e, layers[0].u, layers[1].e, layers[1].u, w, b]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = max(epochs, -(-least_steps * batch // max(len(windows), 1)))
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            i = order[at : at + batch]
            xb, mb = x[i], mask[i]
            grads = gradients(params, xb, mb, y[i], weight[y[i]])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            step += 1
            pace = rate * (1 - 0.9 * step / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, g, a, c in zip(params, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                a += 0.1 * (g - a)
                c += 0.001 * (g * g - c)
                q -= (pace * a / (np.sqrt(c) + 1e-8)).astype(np.float32)
    return Model(layers, w, b, langs)


class Reader:
    """The trained network, laid out for reading many windows at once: states are (H, B), gates' halves folded in."""

    def __init__(self, model: Model):
        self.langs, self.size = model.langs, model.layers[0].u.shape[0]
        half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), self.size)
        self.e = [np.ascontiguousarray((x.e * half).T) for x in model.layers]
        self.u = [np.ascontiguousarray((x.u * half).T) for x in model.layers]
        self.w, self.b = np.ascontiguousarray(model.w.T), model.b[:, None]

    def positions(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Summed position probabilities (B, C) of windows x (T, B); mask (T, B) or None if all are full."""
        size, steps, n = self.size, *x.shape
        states = np.empty((steps, 2 * size, n), np.float32)
        for k in (0, 1):
            h = np.zeros((size, n), np.float32)
            for t in range(steps)[:: -1 if k else 1]:
                a, g = self.e[k].take(x[t], axis=1), self.u[k] @ h
                gate = a[: 2 * size]
                gate += g[: 2 * size]
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
                c = g[2 * size :]
                c *= gate[size:]
                c += a[2 * size :]
                np.tanh(c, out=c)
                h -= c
                h *= gate[:size]
                h += c
                if mask is not None:
                    h *= mask[t]
                states[t, k * size : (k + 1) * size] = h
        total = np.zeros((len(self.langs), n), np.float32)
        for t in range(steps):
            p = self.w @ states[t]
            p += self.b
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            if mask is not None:
                p *= mask[t]
            total += p
        return total.T

    def documents(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pooled probabilities (rows, C)."""
        raw = _FOLD[raw]
        size = np.diff(offsets)
        out = np.zeros((len(size), len(self.langs)))
        full, rest = size // WINDOW, size % WINDOW
        of = np.repeat(np.arange(len(size)), full)
        start = offsets[:-1][of] + WINDOW * (np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full))
        steps = np.arange(WINDOW)[:, None]
        for at in range(0, len(of), BATCH):
            s = slice(at, at + BATCH)
            got = self.positions(raw[start[s][None, :] + steps], None)
            np.add.at(out, of[s], got)
        part = np.flatnonzero(rest)
        for at in range(0, len(part), BATCH):
            i = part[at : at + BATCH]
            i = i[np.argsort(rest[i], kind="stable")]
            long = int(rest[i].max())
            step = np.arange(long)[:, None]
            where = offsets[i] + full[i] * WINDOW
            mask = step < rest[i]
            got = self.positions(np.where(mask, raw[np.minimum(where + step, len(raw) - 1)], 0), mask.astype(np.float32))
            out[i] += got
        return out / np.maximum(size, 1)[:, None]


def has_letter(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    got = tk.sum_by_row(_LETTER[raw], offsets) > 0
    for i in np.flatnonzero(~got & (np.diff(offsets) > 0)):
        got[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return got


def fit(docs: DataFrame, teach: Column | None = None, per_lang: int = 1500, per_doc: int = 4, most_docs: int = 96000, id_col: str = "doc_id") -> Model | None:
    """Train on windows of about ``per_lang`` documents of each language (every document, where there are fewer)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if teach is None else rows.where(teach)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    each = min(per_lang, max(1, most_docs // len(counts)))
    rate = F.create_map(*[F.lit(v) for x in counts for v in (x["lang"], min(1.0, each / x["n"]))])
    drawn = rows.where((F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)) < F.element_at(rate, F.col("lang"))).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            raw, offsets = tk.string_buffers(part.column(1))
            langs, out = [], []
            for i, lang in enumerate(part.column(0).to_pylist()):
                text = _FOLD[raw[offsets[i] : offsets[i + 1]]].tobytes()
                n = -(-len(text) // WINDOW)
                rng = np.random.Generator(np.random.PCG64(len(text) * 1000003 + sum(text[:64])))
                for k in sorted(rng.choice(n, min(n, per_doc), replace=False)) if n else ():
                    langs.append(lang)
                    out.append(text[k * WINDOW : (k + 1) * WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    got = drawn.mapInArrow(cut, "lang string, window binary").distinct().toPandas().sort_values(["lang", "window"])
    if not len(got):
        return None
    return train(got["window"].tolist(), got["lang"].tolist())


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value) if sent.value else None
        for part in tk.slices(batches, text_col):
            raw, offsets = tk.string_buffers(part.column(1))
            known = has_letter(part.column(1), raw, offsets) if reader else np.zeros(part.num_rows, bool)
            best, score = np.zeros(part.num_rows, int), np.zeros(part.num_rows)
            if reader:
                p = reader.documents(raw, offsets)
                best = p.argmax(axis=1)
                score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            names = [reader.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")
