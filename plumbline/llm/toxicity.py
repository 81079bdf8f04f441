"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a whole text: words, word pairs and skip pairs (one word between), hashed to 2**BITS places; a place's value
is its count over the square root of the number of all features. The bias is fixed at the label's log odds (0.4 at most), so
a text without any known feature scores as a common one. Every coordinate has its own learning rate; L1 keeps
most weights at zero, so the model that executors get is a short list of (place, weight), at most 2**BITS long.

Training reads a bounded sample of labelled rows (``max_train``); scoring reads every text whole. Nulls: a null text is
an empty one and scores as the bias alone; null labels teach nothing. No labelled rows: the score is 0 everywhere.
Ties and repeated rows are scored alike; texts of any length are read whole; empty tables give no rows; other columns are
kept, but out of the score (an earlier ``toxic_score`` is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from . import textkit as tk

BITS = 20
_U = np.uint64


def features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of words, pairs and skip pairs, each with n+1 offsets by row."""
    h, rows = tk.words(raw, offsets)
    keep = _U(64 - BITS)
    out = [((h * _U(0xD6E8FEB86659FD93)) >> keep, rows)]
    of = tk.row_index(rows)
    for gap, salt in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        same = of[gap:] == of[:-gap] if len(of) > gap else np.zeros(0, bool)
        joined = ((h[:-gap] * _U(salt) ^ (h[gap:] >> _U(7))) * _U(0x9E3779B97F4A7C15)) if len(of) > gap else h[:0]
        count = np.maximum(np.diff(rows) - gap, 0)
        out.append((joined[same] >> keep, np.concatenate([[0], np.cumsum(count)])))
    return out


def counted(texts: pa.Array, chunk: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places and their values, row by row in flat arrays, and n+1 offsets into them."""
    places, values, sizes = [], [], []
    for k in range(0, len(texts), chunk):
        found = features(*tk.string_buffers(texts[k : k + chunk]))
        key = np.sort(np.concatenate([(tk.row_index(rows) << BITS) | p.astype(np.int64) for p, rows in found]))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count, row = np.diff(np.append(first, len(key))), key[first] >> BITS
        total = sum(np.diff(rows) for _, rows in found)
        places.append((key[first] & ((1 << BITS) - 1)).astype(np.int32))
        values.append((count / np.sqrt(np.maximum(total[row], 1))).astype(np.float32))
        sizes.append(np.bincount(row, minlength=len(total)))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return (np.concatenate(places), np.concatenate(values), offsets) if places else (np.zeros(0, np.int32), np.zeros(0, np.float32), offsets)


@dataclass
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.places] = self.weights
        return w


def scores(model_dense: np.ndarray, bias: float, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for places, rows in features(raw, offsets):
        total += tk.sum_by_row(model_dense[places], rows)
        n += np.diff(rows)
    x = bias + total / np.sqrt(np.maximum(n, 1))
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: pa.Array, labels: list[int], epochs: int = 4, alpha: float = 20.0, beta: float = 1.0, l1: float = 0.6, l2: float = 0.01) -> Model:
    """FTRL-proximal, one document at a time, in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    places, values, rows = counted(texts)
    y = np.asarray(labels, float)
    rate = min(max(float(y.mean()), 0.001), 0.4)
    bias = float(np.log(rate / (1 - rate)))
    shrink = lambda z, n: np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for at, to, label in zip(rows[:-1], rows[1:], y, strict=True):
            i, x = places[at:to], values[at:to]
            zi, ni = z[i], n[i]
            w = shrink(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(bias + w @ x, -40, 40))) - label) * x
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] += g * g
    w = shrink(z, n)
    at = np.flatnonzero(w)
    return Model(at, w[at].astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, teach: Column | None = None, max_train: int = 12000) -> Model | None:
    """Train on at most ``max_train`` labelled documents, chosen by a hash of their ids."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if teach is None else rows.where(teach)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic_label"))
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = rows.orderBy(order, "doc_id").limit(max_train)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(order.alias("place"), "doc_id", "text", "toxic_label").toArrow()
    ids, place = got["doc_id"].to_numpy(), got["place"].to_numpy()
    turn = np.lexsort((ids, place))
    turn = turn[np.concatenate([[True], ids[turn][1:] != ids[turn][:-1]])] if len(turn) else turn
    if not len(turn):
        return None
    got = got.select(["text", "toxic_label"]).take(pa.array(turn)).combine_chunks()
    model = train(got["text"].chunk(0), got["toxic_label"].to_pylist())
    del got
    pa.default_memory_pool().release_unused()  # the driver lives on
    return model


def score_documents(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and, last, ``toxic_score`` double."""
    from pyspark.sql import types as T

    out = T.StructType([f for f in docs.schema.fields if f.name != "toxic_score"] + [T.StructField("toxic_score", T.DoubleType())])
    kept = docs.select(*[F.col(f"`{f.name}`") for f in out.fields[:-1]])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        dense = model.dense() if model else None
        for part in tk.slices(batches, text_col):
            raw, offsets = tk.string_buffers(part.column(part.schema.get_field_index(text_col)))
            got = scores(dense, model.bias, raw, offsets) if model else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], [*part.schema.names, "toxic_score"])

    return kept.mapInArrow(run, out)


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, unchanged and in place: no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        dense = model.dense() if model else None
        for part in tk.slices(batches, text_col):
            raw, offsets = tk.string_buffers(part.column(part.schema.get_field_index(text_col)))
            yield part.filter(pa.array(scores(dense, model.bias, raw, offsets) < threshold)) if model else part

    return docs.mapInArrow(run, docs.schema)
