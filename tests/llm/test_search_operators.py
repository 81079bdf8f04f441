"""Exact top-k search, ranked lexical search and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import importance, passes, search, topk


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


# 11 exact top-k search


def best_vectors(rows, asks, k, scale=256):
    ok = []
    for n, (i, v, *_) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(scale * x) for x in v]
            if all(abs(x) <= topk.LARGEST for x in q):
                ok.append((n, i, q))
    out = []
    for n, i, q in ok:
        if i is not None and asks(i):
            near = sorted((-sum(a * b for a, b in zip(q, r, strict=True)), j is None, j or 0, m) for m, j, r in ok if m != n and len(r) == len(q))
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j, _) in enumerate(near[:k], 1)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, number int").repartition(3)


@pytest.mark.parametrize("spread", [1.0, 0.01, 40.0])
def test_topk_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "PASS_BYTES", 2000)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, spread, (6, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(0, spread / 3, 16)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(50, rows[50][1]), (2000, [0.0] * 16), (2050, None), (2100, [float("nan")] * 16), (2150, [None] + [1.0] * 15), (2200, [float("inf")] * 16), (2250, [1.0, 2.0]), (2300, [3.0, -1.0]), (2350, []), (2400, []), (None, rows[3][1]), (2450, [1e30] * 16)]
    got = topk.search(vectors(spark, rows), asks=F.col("vec_id") % 50 == 0).collect()
    assert sorted((tuple(r) for r in got), key=str) == best_vectors(rows, lambda i: i % 50 == 0, 5)


def test_topk_of_few_rows_and_none(spark):
    assert topk.search(vectors(spark, []), asks=F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(vectors(spark, [(1, [1.0])]), asks=F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(vectors(spark, [(50, [1.0])]), asks=F.col("vec_id") % 50 == 0).count() == 0
    rows = [(50, [1.0, -1.0]), (1, [-1.0, 1.0]), (100, [-2.0, 0.5])]
    got = topk.search(vectors(spark, rows), asks=F.col("vec_id") % 50 == 0, k=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == best_vectors(rows, lambda i: i % 50 == 0, 2)


def test_topk_stops_early_and_proves_it():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 32, (3000, 64)).astype(np.int32)
    x[7] = x[0] + 1
    order = np.argsort(x, axis=0, kind="stable").T
    block = topk.Block(64, 3000, np.arange(3000).tobytes(), np.ones(3000, bool).tobytes(), np.arange(3000).tobytes(), order.astype(np.uint16).tobytes(), np.take_along_axis(x.T, order, axis=1).tobytes())
    for own in range(40):
        may = block.possible(x[own].astype(np.int64), own, 5, None)
        score = x.astype(np.int64) @ x[own]
        score[own] = -(1 << 60)
        assert set(np.flatnonzero(score >= np.sort(score)[-5])) <= set(may) and own not in may
    assert len(block.possible(x[0].astype(np.int64), 0, 5, None)) < 300


def block_of(x, first=0, ids=None):
    order = np.argsort(x, axis=0, kind="stable").T
    ids = np.arange(first, first + len(x)) if ids is None else ids
    return topk.Block(x.shape[1], len(x), ids.tobytes(), np.ones(len(x), bool).tobytes(), np.arange(first, first + len(x)).tobytes(), order.astype(np.uint16).tobytes(), np.take_along_axis(x.T, order, axis=1).tobytes())


@pytest.mark.parametrize("kind", ["plain", "heavy", "huge", "below", "copies", "zeros"])
def test_topk_of_many_queries_over_blocks(kind, monkeypatch):
    monkeypatch.setattr(topk, "TOGETHER", 7)
    monkeypatch.setattr(topk, "PAIRS", 100)
    rng = np.random.default_rng(11)
    if kind == "heavy":  # few large components: the first level that can exclude takes in few postings
        x = np.where(rng.random((900, 64)) < 0.04, rng.normal(0, 3000, (900, 64)), rng.normal(0, 1, (900, 64)))
    elif kind == "huge":
        x = rng.choice([-1, 1], (900, 64)) * (topk.LARGEST - rng.integers(0, 3, (900, 64)))
    elif kind == "below":  # all scores of the only query that looks the other way are negative
        x = rng.integers(1, 99, (900, 8))
        x[20] *= -1
    else:
        x = rng.normal(0, 32, (900, 16))
    x = x.astype(np.int32)
    if kind == "copies":
        x[100:700] = x[0]
    if kind == "zeros":
        x[::20] = 0
    ids = rng.permutation(900)
    asked = topk.Asked(x.shape[1], [(n, int(ids[n]), x[n].tobytes()) for n in range(0, 900, 20)], 5)
    few = 0
    for a, b in ((0, 3), (3, 300), (300, 301), (301, 900)):
        block = block_of(x[a:b], a, ids[a:b])
        few += int(block.sparse(asked.vectors, asked.least).sum())
        asked.meet(block)
    assert few > 9 or kind != "heavy"
    for n, own in enumerate(range(0, 900, 20)):
        score = x.astype(np.int64) @ x[own].astype(np.int64)
        others = np.flatnonzero(np.arange(900) != own)
        best = others[np.lexsort((ids[others], -score[others]))[:5]]
        got, _, found, rows = (c[n] for c in asked.best)
        assert (got.tolist(), found.tolist(), rows.tolist()) == (score[best].tolist(), ids[best].tolist(), best.tolist())


def test_topk_reads_level_0_for_many_queries_together(monkeypatch):
    """Without large impacts no query reads postings by itself, and few of the pairs are scored."""
    x = np.random.default_rng(2).normal(0, 32, (8192, 64)).astype(np.int32)
    calls, scored, einsum = [], [], np.einsum
    monkeypatch.setattr(topk.Block, "possible", lambda *a: calls.append(a))
    asked = topk.Asked(64, [(n, n, x[n].tobytes()) for n in range(512)], 5)
    asked.meet(block_of(x[:4096]))
    monkeypatch.setattr(np, "einsum", lambda form, a, b: (scored.append(a.size // 64), einsum(form, a, b))[1])
    asked.meet(block_of(x[4096:], 4096))
    assert not calls and 0 < sum(scored) < 4096 * 512 // 5


def test_quantise_keeps_lengths_apart_and_slices():
    column = pa.array([[1.0], [0.5, -0.001], None, [2.0, None], [], [float("nan")], [3.0, 4.0]], pa.list_(pa.float32()))
    got = {x.shape[1]: (of.tolist(), x.tolist()) for of, x in topk.quantise(column, 256)}
    assert got == {0: ([4], [[]]), 1: ([0], [[256]]), 2: ([1, 6], [[128, -1], [768, 1024]])}
    got = {x.shape[1]: (of.tolist(), x.tolist()) for of, x in topk.quantise(column.slice(1, 3), 256)}
    assert got == {2: ([0], [[128, -1]])}


# 12 ranked lexical search


def ranked(docs, items, k=10):
    tf = [Counter(words(t)) for _, t, *_ in docs]
    n = [sum(c.values()) for c in tf]
    total, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, *_), c, m in zip(docs, tf, n, strict=True):
            if m:
                norm = 10 + (90 * m * total) // length
                s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * norm)) for t in set(words(text)) if c[t])
                if s > 0:
                    found.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shape", [(4, 50, 1 << 20, 2), (128, 1 << 16, 700, 32), (8, 1 << 16, 1 << 20, 10**9)])
def test_search_equals_brute_force(spark, docs_frame, odd_texts, sentences, monkeypatch, shape):
    monkeypatch.setattr(search, "BLOCK", shape[0])
    monkeypatch.setattr(search, "SHARD_DOCS", shape[1])
    monkeypatch.setattr(search, "SHARD_WORDS", shape[2])
    monkeypatch.setattr(search, "STRETCH", 3)
    monkeypatch.setattr(search, "SPARSE", shape[3])
    monkeypatch.setattr(search, "PASS_BYTES", 3000)
    rng = random.Random(2)
    rows = [(100 + i, sentences(i, rng.randint(1, 60), 300)) for i in range(250)]
    rows += [(400 + i, rows[3][1]) for i in range(15)] + odd_texts + [(None, rows[5][1]), (900, "The, the; THE w1-w2 w1.w3 ?"), (901, "w1 " * 70000)]
    items = [(1, rows[3][1]), (2, "w1 w2 W3, w4"), (3, None), (4, "?!"), (5, "unheard of"), (None, "w7 w8"), (2, "w1 w2 W3, w4"), (6, sentences(77, 400, 300)), (7, "日本語のテキスト ё"), (8, "the")]
    frame = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, term string")
    got = search.search(docs_frame(rows).repartition(3), frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranked(rows, items)


def test_search_of_empty_sides(spark, docs_frame):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert search.search(docs_frame([]), items).count() == 0
    assert search.search(docs_frame([(1, None), (2, "...")]), items).count() == 0
    assert search.search(docs_frame([(1, "some words")]), items.limit(0)).count() == 0


def rows_of(got, ids, norms):
    n = len(got["df"])
    out = [{"term": None, "ids": ids.tobytes(), "norms": norms.tobytes(), "widths": np.ones(len(ids), bool).tobytes()}]
    return out + [{"term": int(got["term"][i]), "df": int(got["df"][i]), **{c: got[c][i].as_py() for c in ("first", "last", "peak", "widths", "data")}} for i in range(n)]


def test_blocks_decompress_to_what_was_stored_and_are_skipped():
    rng = np.random.default_rng(3)
    docs = 300000
    often = np.sort(rng.choice(docs, 150000, replace=False))
    doc = np.concatenate([often, np.repeat(often[:2000], 300), [5, 290000], [77]])
    term = np.concatenate([np.full(len(often) + 600000, 1), [2, 2], [3]]).astype(np.uint64)
    norms = rng.integers(10, 4000, docs)
    norms[[5, 77, 290000]] = 10
    shard = search.Shard(rows_of(search.build_shard(term, doc, norms), np.arange(docs), norms))
    a, b = shard.at[1]
    found, of = shard.documents(np.arange(a, b))
    assert found.tolist() == often.tolist()
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    tf = shard.frequencies(np.arange(a, b)[of], nth)
    assert tf.tolist() == [301] * 2000 + [1] * 148000
    before = shard.decompressed
    top, scores = shard.top([1, 2], [1, 1000], 2)
    score = {d: 1000 * int(search.impact(np.array(1), norms[d])) for d in (5, 290000)}
    for d, f in zip(found, tf, strict=True):
        if d in score:
            score[d] += int(search.impact(f, norms[d]))
    assert dict(zip(top.tolist(), scores.tolist(), strict=True)) == score
    assert shard.decompressed - before < 60 < b - a


# 13 importance resampling


def drawn(docs, target, percent=10, least=20, longest=1, buckets=10000, seed=2024):
    def feats(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    of = [feats(t) for _, t, *_ in docs]
    s, t = Counter(x for f in of for x in f), Counter(x for _, y in target for x in feats(y))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for (i, text, *_), f in zip(docs, of, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, docs_frame, odd_texts, sentences, longest):
    rows = [(100 + i, sentences(i, 5 + i % 60, 500)) for i in range(300)] + [(600 + i, "Copy: " + sentences(1, 40)) for i in range(80)]
    rows += odd_texts + [(None, sentences(8, 30)), (950, "W1, w1; É é ñ " + "z" * 47 + " " + "z" * 48 + " " + "z" * 49 + " x" * 30)]
    target = [(1, sentences(500, 200, 40)), (2, None), (3, ""), (4, "w1 W1")]
    frame = spark.createDataFrame([(*x, 1) for x in target], "item_id long, text string, key int")
    got = importance.resample(docs_frame(rows).repartition(5), frame, longest=longest)
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn(rows, target, longest=longest)
    nothing = importance.resample(docs_frame(rows[:40]), frame.limit(0), percent=50).collect()
    assert sorted((tuple(r) for r in nothing), key=str) == drawn(rows[:40], [], percent=50)
    assert importance.resample(docs_frame([]), frame).count() == 0


def test_crc_of_spans():
    raw = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    starts, ends = np.array([0, 5, 9, 100, 3, 700]), np.array([0, 6, 60, 107, 51, 768])
    assert importance.crc32(raw, starts, ends).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


# passes


def test_passes_fit_or_hold_one_key(spark):
    rows = [(k, 10) for k in range(200) for _ in range(3)] + [(1000, 5000)]
    dealt, count = passes.deal(spark.createDataFrame(rows, "k long, size int"), "k", "size", 600)
    got = dealt.groupBy("pass").agg(F.sum("size").alias("n"), F.countDistinct("k").alias("keys")).collect()
    assert dealt.count() == len(rows) and all(r.n <= 600 or r["keys"] == 1 for r in got) and max(r["pass"] for r in got) < count
    assert dealt.groupBy("k").agg(F.countDistinct("pass").alias("n")).where("n > 1").isEmpty()
    assert passes.deal(spark.createDataFrame([], "k long, size int"), "k", "size", 600)[1] == 0
