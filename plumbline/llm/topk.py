"""Exact top-k search by inner product: an impact-ordered index, read score-at-a-time.

Components are quantised to floor(scale * x). A block of the index holds, for every dimension, its vectors ordered by
their component there: a posting segment is the run of vectors that share a component, and its impact for a query is the
query's component times it. Segments of all dimensions are processed by descending impact, one level of impacts after
another, and their postings added to accumulators. An unread segment of a level adds at most that level, so a vector's
score is at most its accumulator plus the level for each dimension in which it was not met yet. The best accumulators
are scored exactly, which gives a k-th best score that only rises. Reading stops when few vectors can still reach it
(levels halve down to 0 and then go below it, where unread segments can only lower a score): all vectors that might, ties
included, are the possible members, and they are scored exactly. No vector is left out without that proof.

Levels that can exclude no vector (a vector not met yet could still reach the k-th best score) are passed over. If the
first level that can takes in few postings, they are added one by one, each query by itself. Otherwise reading goes on to
level 0 at once, for many queries together: all segments of positive impact are the product of the positive parts of
queries and vectors plus that of their negative parts. Vectors whose accumulators stay under the k-th best score are out;
only the rest are scored.

The index is made in place, block by block, without a shuffle. Queries are dealt into passes of at most PASS_BYTES,
measured; each pass reads the index once and sends k rows for each query and task on to the last sort, never all pairs.

Vectors that are null, or hold null or non-finite components, take no part, and neither do those with a quantised
component beyond LARGEST (their scores might not fit a long). Vectors of different lengths do not meet; empty ones score
0 with each other. Equal scores are ordered by the smaller id, null ids last, then by row. Repeated rows are candidates
and queries of their own: only the query's own row is left out. An empty table, or one without queries, gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .passes import deal
from .store import cut, release

BLOCK = 4096
LARGEST = 1 << 25
PASS_BYTES = 8 << 20
FEW = 32
STEPS = 16
TOGETHER = 256
SPARSE = 16
PAIRS = 1 << 12
THIN = 32
NONE = np.iinfo(np.int64).min
INDEX = "dim int, rows int, ids binary, known binary, numbers binary, ordered binary, components binary"


def quantise(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, integer components as rows of a matrix) for each length of the vectors that take part."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat, base = column.values, int(offsets[0]) if n else 0
    parts = flat.slice(base, (int(offsets[-1]) - base) if n else 0)
    good = np.isfinite(values := parts.to_numpy(zero_copy_only=False))
    if parts.null_count:
        good &= ~parts.is_null().to_numpy(zero_copy_only=False)
    whole = np.floor(np.where(good, values, 0.0) * scale)
    good &= np.abs(whole) <= LARGEST
    bad = np.concatenate([[0], np.cumsum(~good)])
    at = offsets - base
    takes = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]))
    length = np.diff(at)
    for dim in np.unique(length[takes]):
        of = takes[length[takes] == dim]
        yield of, whole[at[of][:, None] + np.arange(dim)].astype(np.int32)


def _blocks(frame: DataFrame, scale: int) -> DataFrame:
    """The index: a row for each block, with vectors in order of every dimension's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, {}

        def out(dim: int) -> pa.RecordBatch:
            ids, known, numbers, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            order = np.argsort(x, axis=0, kind="stable").T
            row = [ids.tobytes(), known.tobytes(), numbers.tobytes(), order.astype(np.uint16).tobytes(), np.take_along_axis(x.T, order, axis=1).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([c], pa.binary()) for c in row)], ["dim", "rows", "ids", "known", "numbers", "ordered", "components"])

        for batch in batches:
            ids = batch.column(0)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for of, x in quantise(batch.column(1), scale):
                dim, at = x.shape[1], 0
                while at < len(of):
                    have = sum(len(c[0]) for c in held.get(dim, ()))
                    to = min(at + BLOCK - have, len(of))
                    held.setdefault(dim, []).append((ids[of[at:to]], known[of[at:to]], number + of[at:to], x[at:to]))
                    at = to
                    if have + to - at >= BLOCK or sum(len(c[0]) for c in held[dim]) == BLOCK:
                        yield out(dim)
            number += batch.num_rows
        for dim in list(held):
            yield out(dim)

    return frame.mapInArrow(run, INDEX)


class Block:
    """One block of the index in memory."""

    def __init__(self, dim: int, rows: int, ids: bytes, known: bytes, numbers: bytes, ordered: bytes, components: bytes):
        self.dim, self.rows = dim, rows
        self.ids, self.known, self.numbers = np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(numbers, np.int64)
        self.ordered = np.frombuffer(ordered, np.uint16).reshape(dim, rows)
        self.components = np.frombuffer(components, np.int32).reshape(dim, rows)
        self.vectors = np.empty((rows, dim), np.int32)
        for d in range(dim):
            self.vectors[self.ordered[d], d] = self.components[d]
        self.low = self.components[:, 0].astype(np.int64) if rows else np.zeros(dim, np.int64)
        self.high = self.components[:, -1].astype(np.int64) if rows else np.zeros(dim, np.int64)
        self.largest = np.maximum(np.abs(self.low), np.abs(self.high)).astype(np.float64)
        # all dimensions' components as one ascending array: a lookup for each dimension is one search
        self.width = int((self.high - self.low).max(initial=0)) + 3
        self.keys = (self.components - self.low[:, None] + 1 + np.arange(dim)[:, None] * self.width).ravel()
        self.thin = self.keys.reshape(dim, rows)[:, ::THIN].ravel()
        self.parts: dict[type, np.ndarray] = {}

    def score(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ query

    def ends(self, query: np.ndarray, level: int | np.ndarray, every: int = 1) -> np.ndarray:
        """For each dimension, how many postings lie before the segments whose impact exceeds ``level`` (query > 0) or in them (query < 0).

        With ``every``, about as many: only one posting in so many is looked at.
        """
        bound = level // np.maximum(np.abs(query), 1)
        least = np.where(query > 0, bound + 1, -bound)  # components from it on exceed the level, or (query < 0) those before it
        at = np.clip(least - self.low + 1, 0, self.width - 1) + np.arange(self.dim) * self.width
        keys = self.keys if every == 1 else self.thin
        return (np.searchsorted(keys, at) - np.arange(self.dim) * -(-self.rows // every)) * every

    def possible(self, query: np.ndarray, own: int, k: int, least: int | None, most: int | None = None) -> np.ndarray | None:
        """Rows that may be among the query's best k, given that ``least`` (if any) is reached by k others already.

        None, if that takes more than ``most`` postings.
        """
        others = self.numbers != own
        live, rise = np.flatnonzero(query), query > 0
        impacts = np.where(rise, query * self.high, query * self.low)
        level = max(int(impacts.max(initial=0)), 1)
        step = low = max(level // STEPS, 1)
        if least is not None and least > 0 and len(live):
            first = (least - 1) // len(live)  # at any level above it, a row not met yet may still reach ``least``
            level, low = min(level, 2 * first + 1), min(low, first)
        lowest = int(np.where(rise, query * self.low, query * self.high).min(initial=0))
        reach = float(np.abs(query) @ self.largest)
        slack = reach * 2.0**-32 if reach >= 1 << 53 else 0.0  # sums up to there are exact
        total, met = np.zeros(self.rows), np.zeros(self.rows, np.int64)
        done, read = np.where(rise, self.rows, 0), 0
        while level > lowest:
            level = level // 2 if level > low else 0 if level > 0 else 2 * level or -step
            now = self.ends(query, level)
            spans = [(d, now[d], done[d]) if rise[d] else (d, done[d], now[d]) for d in live]
            spans = [(d, a, b) for d, a, b in spans if a < b]
            done = now
            read += sum(b - a for _, a, b in spans)
            if most is not None and read > most:
                return None
            if spans:
                rows = np.concatenate([self.ordered[d, a:b] for d, a, b in spans])
                found = np.concatenate([self.components[d, a:b] for d, a, b in spans]) * np.repeat(query[[d for d, _, _ in spans]], [b - a for _, a, b in spans])
                total += np.bincount(rows, found, self.rows)
                met += np.bincount(rows, minlength=self.rows)
            if self.rows > k:
                best = np.argpartition(np.where(others, total, -np.inf), self.rows - k)[self.rows - k :]
                best = best[others[best]]
                if len(best) == k:
                    floor = int(self.score(best, query).min())
                    least = floor if least is None else max(least, floor)
            if least is not None:
                may = np.flatnonzero(others & (total + level * (len(live) - met) + slack >= least))
                if len(may) <= max(4 * k, self.rows // FEW):
                    return may
        return np.flatnonzero(others) if least is None else np.flatnonzero(others & (total + slack >= least))

    def sparse(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Queries for which the first level that can exclude rows takes in few postings."""
        level = (np.maximum(least, 1) - 1) // np.maximum(np.count_nonzero(queries, axis=1), 1)
        ends = self.ends(queries, level[:, None], THIN)
        read = np.where(queries > 0, self.rows - ends, np.where(queries < 0, ends, 0)).sum(axis=1)
        return (least > 0) & (read <= self.rows * self.dim // SPARSE)

    def above(self, queries: np.ndarray, kind: type) -> np.ndarray:
        """Accumulators at level 0, queries by rows: the sums of all positive impacts."""
        if kind not in self.parts:
            self.parts[kind] = np.concatenate([np.maximum(self.vectors, 0), np.maximum(-self.vectors, 0)], axis=1).astype(kind)
        return np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1).astype(kind) @ self.parts[kind].T

    def together(self, queries: np.ndarray, owns: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of possible members, by level 0 for all queries; ``least`` (NONE: none) is raised in place."""
        reach = float((np.abs(queries) @ self.largest).max(initial=0))
        kind = np.float32 if reach < 1 << 24 else np.float64  # whole numbers, and their sums up to there, are exact
        exact = kind if reach < 1 << 53 else np.int64
        asked, vectors = queries.astype(exact), self.vectors.astype(exact)
        total = self.above(queries, kind)
        at = np.minimum(np.searchsorted(self.numbers, owns), self.rows - 1)  # numbers ascend in a block
        own = np.flatnonzero(self.numbers[at] == owns)
        total[own, at[own]] = -np.inf
        new = np.flatnonzero(least == NONE)
        if len(new) and self.rows > k:
            n = min(8 * k, self.rows)
            best = np.argpartition(total[new], self.rows - n, axis=1)[:, self.rows - n :]
            score = np.einsum("qrd,qd->qr", vectors[best], asked[new]).astype(np.int64)
            score[np.isneginf(np.take_along_axis(total[new], best, axis=1))] = NONE
            least[new] = np.partition(score, n - k, axis=1)[:, n - k]
        bound = np.maximum(least - np.abs(least.astype(np.float64)) * 2.0**-32, np.finfo(kind).min).astype(kind)
        pairs = np.flatnonzero(total >= bound[:, None])
        found = [(np.zeros(0, np.int64),) * 3]
        for part in range(0, len(pairs), PAIRS):
            q, r = np.divmod(pairs[part : part + PAIRS], self.rows)
            score = np.einsum("pd,pd->p", vectors.take(r, axis=0), asked.take(q, axis=0)).astype(np.int64)
            keep = score >= least[q]
            found.append((q[keep], r[keep], score[keep]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def members(self, queries: np.ndarray, owns: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, score) of rows that may be among a query's best k, ``least`` (NONE: none) being reached by k others already."""
        for at in range(0, len(queries) if self.rows else 0, TOGETHER):
            of = np.arange(at, min(at + TOGETHER, len(queries)))
            sparse = self.sparse(queries[of], least[of])
            for n in np.flatnonzero(sparse):
                may = self.possible(queries[of[n]], owns[of[n]], k, int(least[of[n]]), self.rows * self.dim // SPARSE)
                if may is None:
                    sparse[n] = False
                elif len(may):
                    yield np.full(len(may), of[n]), may, self.score(may, queries[of[n]])
            of = of[~sparse]
            if len(of):
                q, rows, score = self.together(queries[of], owns[of], k, least[of])
                if len(q):
                    yield of[q], rows, score


class Asked:
    """The queries of one length in a task, with the best k of the blocks they met."""

    def __init__(self, dim: int, rows: list[tuple[int, int | None, bytes]], k: int):
        self.owns, self.ids = np.array([n for n, _, _ in rows], np.int64), [i for _, i, _ in rows]
        self.vectors = np.frombuffer(b"".join(v for _, _, v in rows), np.int32).reshape(len(rows), dim).astype(np.int64)
        self.k, self.least, shape = k, np.full(len(rows), NONE), (len(rows), k)
        self.filled, self.best = np.zeros(shape, bool), (np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape, np.int64), np.zeros(shape, np.int64))

    def meet(self, block: Block) -> None:
        """Scores, whether the id is unknown, ids and rows of the best, with those of ``block``."""
        for q, rows, score in block.members(self.vectors, self.owns, self.k, self.least):
            touched = np.unique(q)
            n, rank = np.nonzero(self.filled[touched])
            q = np.concatenate([q, touched[n]])
            new = score, ~block.known[rows], block.ids[rows], block.numbers[rows]
            new = [np.concatenate([a, b[touched[n], rank]]) for a, b in zip(new, self.best, strict=True)]
            order = np.lexsort((new[3], new[2], new[1], -new[0], q))
            q = q[order]
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            rank = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
            keep = rank < self.k
            to = q[keep], rank[keep]
            for a, b in zip(self.best, new, strict=True):
                a[to] = b[order[keep]]
            self.filled[to] = True
            self.least[touched] = np.where(self.filled[touched, -1], self.best[0][touched, -1], NONE)

    def found(self) -> pa.RecordBatch:
        n, rank = np.nonzero(self.filled)
        score, unknown, ids, rows = (c[n, rank] for c in self.best)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.owns[n]), pa.array([self.ids[i] for i in n], pa.int64()), pa.array(score), pa.array(ids, pa.int64(), mask=unknown), pa.array(rows)],
            ["number", "query_id", "score", "vec_id", "row"],
        )


def _search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of each task for each query of one pass."""
    sets: dict[int, list] = {}
    for x in queries.select("dim", "number", "query_id", "vector").collect():
        sets.setdefault(x.dim, []).append((x.number, x.query_id, bytes(x.vector)))
    sent = index.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {dim: Asked(dim, rows, k) for dim, rows in sent.value.items()}
        for batch in batches:
            for at in range(batch.num_rows):
                if (dim := batch.column(0)[at].as_py()) in asked:
                    asked[dim].meet(Block(*(c[at].as_py() for c in batch.columns)))
        for queries in asked.values():
            yield queries.found()

    return index.mapInArrow(run, "number long, query_id long, score long, vec_id long, row long")


def search(frame: DataFrame, asks: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``asks`` (a condition on ``vec_id``) holds, its k best other rows."""
    index = cut(_blocks(frame.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")), scale), "impact-index")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(*(c[at].as_py() for c in batch.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(block.rows, block.dim, np.int32)), pa.array(block.numbers), pa.array(block.ids, mask=~block.known), pa.array([v.tobytes() for v in block.vectors], pa.binary())], ["dim", "number", "vec_id", "vector"]
                )

    asked = index.mapInArrow(members, "dim int, number long, vec_id long, vector binary").where(asks).withColumnRenamed("vec_id", "query_id")
    asked = cut(asked.withColumn("size", F.length("vector") + 64), "impact-queries")
    dealt, count = deal(asked, "number", "size", PASS_BYTES)
    best = None
    for n in range(count):
        one = _search(index, dealt.where(F.col("pass") == n), k)
        if count > 1:
            one = cut(one, "impact-best")
        best = one if best is None else best.unionByName(one)
    if best is None:
        release(index, asked)
        return frame.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
