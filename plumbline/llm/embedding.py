"""Embedding near-duplicates: an exact metric range join by cosine, over cells around pivots.

Unit vectors make cosine >= c a Euclidean range r = sqrt(2 - 2c). Pivots, drawn by hash from the distinct vectors,
partition them into cells of nearest pivots. A vector x of cell i can only have a partner in cell j if the triangle
inequality lets it: d(x, pj) <= r + (largest distance from pj in cell j), d(x, pj) - d(x, pi) <= 2 r, and x lies within
r of the plane between pi and pj. Then, and only then, x meets j's vectors. Each cell is written in blocks of bounded size, one row a block. Pairs of blocks
whose cells can hold a link are a product of that table with itself: its files are read again by each task, and vectors are
shuffled twice whatever their number, so disk grows with the input though the work may grow with its square. The bounds
on single vectors hold where a block is streamed past another; so a vector meets all its partners there.
Links are counted there and only spanning forests of them are written, never all pairs. Pivots are as many as cells need
to fit a block, up to PIVOT_BYTES of them in all (131,072 of 64 parts); beyond that cells take more blocks. Where vectors lie without
structure (random ones), the bounds exclude little and the join compares all blocks; the results are the same.

Equal vectors form a class and are compared once. Vectors that are null, empty, zero, or hold null or non-finite parts
link with nothing; so do vectors of different lengths with each other. An empty table gives no rows; extra columns are
ignored; repeated rows are vectors of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import cut, release

LARGEST_BLOCK = 4096
LEAST_BLOCK = 256
LEAST_CELLS = 16
PIVOT_BYTES = 64 << 20
GRID = 1 << 22
MOST_FILES = 64
STREAM = 512
SLACK = 1e-7  # more than the rounding of a distance, which is near sqrt(eps) for near vectors


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out = []
    for v in column:
        x = None
        if v.is_valid and v.values.null_count == 0 and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                x = x / math.sqrt(float(x @ x))
            else:
                x = None
        out.append(x)
    return out


def _units(frame: DataFrame) -> DataFrame:
    """(vec_id, cls, dim, vec): vectors that may link have a class, their length, and their parts in the precision of the source."""
    single = frame.schema["vector"].dataType.elementType.simpleString() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1)
            unit = unit_vectors(raw)
            keys, parts = [], []
            for v, u in zip(raw, unit, strict=True):
                x = None if u is None else v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                keys.append(None if x is None else int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
                parts.append(None if x is None else x.astype(np.float32 if single else np.float64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array([None if u is None else len(u) for u in unit], pa.int32()), pa.array(parts, pa.binary())],
                ["vec_id", "cls", "dim", "vec"],
            )

    return frame.mapInArrow(run, "vec_id long, cls long, dim int, vec binary")


def _unit_rows(raw: bytes, dim: int, rows: int) -> np.ndarray:
    """Unit vectors in double precision from the parts of ``rows`` vectors, of four or eight bytes each."""
    if not rows:
        return np.zeros((0, dim))
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * rows * dim else np.float64).reshape(rows, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _unit_rows(b"".join(column.to_pylist()), dim, len(column))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _by_dim(batch: pa.RecordBatch):
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def _owned(classes: DataFrame, sent) -> DataFrame:
    most = max((len(p) for _, p in sent.value.values()), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in (x for batch in batches for at in range(0, batch.num_rows, max(16, GRID // most)) for x in _by_dim(batch.slice(at, max(16, GRID // most)))):
            first, pivots = sent.value[dim]
            d = _distances(_matrix(part.column(2), dim), pivots)
            own = d.round(9).argmin(axis=1)  # ties go one way, whatever the batch
            yield pa.RecordBatch.from_arrays([pa.array(own + first, pa.int32()), pa.array(d[np.arange(len(own)), own])], ["cell", "far"])

    return classes.select("cls", "dim", "vec").mapInArrow(run, "cell int, far double")


def _blocks(classes: DataFrame, sent, cells: dict[int, tuple[int, float]], r: float, block: int) -> DataFrame:
    """(cell, block, dim, near, cls, n, vec): each block of each cell as one row, with the cells that its vectors may link to."""
    count = max((f + len(p) for f, p in sent.value.values()), default=0)
    reaches = np.array([cells.get(j, (0, -4.0))[1] for j in range(count)])  # below any distance where a cell is empty
    blocks_of = np.array([max(1, -(-cells.get(j, (0, 0.0))[0] // block)) for j in range(count)], np.uint64)
    most = max((len(p) for _, p in sent.value.values()), default=1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, min(2048, GRID // most))
        for dim, part in (x for batch in batches for at in range(0, batch.num_rows, step) for x in _by_dim(batch.slice(at, step))):
            first, pivots = sent.value[dim]
            own = _distances(_matrix(part.column(3), dim), pivots).round(9).argmin(axis=1) + first
            ids = part.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array((ids >> np.uint64(33)) % blocks_of[own], pa.int32()), *part.columns], ["cell", "block", "cls", "dim", "n", "vec"])

    def pack(rows: pa.Table) -> pa.Table:
        cell, nth, dim = (rows.column(k)[0].as_py() for k in (0, 1, 3))
        first, pivots = sent.value[dim]
        reach = reaches[first : first + len(pivots)]
        near = np.flatnonzero(_distances(pivots[cell - first : cell - first + 1], pivots)[0] <= r + reaches[cell] + reach + SLACK) + first
        packed = [rows.column(k).to_numpy().astype(np.int64).tobytes() for k in (2, 4)]
        return pa.table({"cell": pa.array([cell], pa.int32()), "block": pa.array([nth], pa.int32()), "dim": pa.array([dim], pa.int32()), "near": pa.array([near.tolist()], pa.list_(pa.int32())),
                         "cls": pa.array([packed[0]], pa.binary()), "n": pa.array([packed[1]], pa.binary()), "vec": pa.array([b"".join(rows.column(5).to_pylist())], pa.binary())})

    placed = classes.select("cls", "dim", "n", "vec").mapInArrow(place, "cell int, block int, cls long, dim int, n long, vec binary")
    total = int(sum(blocks_of[j] for j in cells))
    placed = placed.repartition(max(1, min(total, MOST_FILES)), "cell", "block")
    return placed.groupBy("cell", "block").applyInArrow(pack, "cell int, block int, dim int, near array<int>, cls binary, n binary, vec binary")


class _Block:
    """A block's own vectors, the links they were found to have, and a forest of those links."""

    def __init__(self, cls: np.ndarray, vec: np.ndarray):
        self.cls, self.vec, self.rough = cls, vec, vec.astype(np.float32)
        self.links, self.label, self.edges = np.zeros(len(cls), np.int64), np.arange(len(cls)), []

    def meet(self, cls: np.ndarray, n: np.ndarray, vec: np.ndarray, c: float):
        """Single precision, whose error is bounded, leaves the few pairs near the threshold to double precision."""
        doubt = 1e-6 * (16 + vec.shape[1])
        rough = self.rough @ vec.astype(np.float32).T
        i, j = np.nonzero(rough >= c - doubt)
        close = np.flatnonzero(rough[i, j] < c + doubt)
        for s in range(0, len(close), GRID // 64):
            part = close[s : s + GRID // 64]
            part = part[np.einsum("ij,ij->i", self.vec[i[part]], vec[j[part]]) < c]
            i[part] = -1
        other = (i >= 0) & (self.cls[i] != cls[j])
        i, j = i[other], j[other]
        if not len(i):
            return
        np.add.at(self.links, i, n[j])
        _, firsts = np.unique(j, return_index=True)
        self.edges.append((cls[j[firsts]], self.cls[i[firsts]]))
        while True:
            least = np.full(len(cls), len(self.cls))
            np.minimum.at(least, j, self.label[i])
            to = np.arange(len(self.cls))
            np.minimum.at(to, self.label[i], least[j])
            after = to[self.label]
            if (after == self.label).all():
                break
            self.label = after

    def done(self) -> Iterator[pa.RecordBatch]:
        u = np.concatenate([self.cls, *(e[0] for e in self.edges)])
        v = np.concatenate([self.cls[self.label], *(e[1] for e in self.edges)])
        keep, found = u != v, self.links > 0
        k, f = int(keep.sum()), int(found.sum())
        yield pa.RecordBatch.from_arrays([pa.array(self.cls[found]), pa.array(self.links[found]), pa.nulls(f, pa.int64())], ["u", "links", "v"])
        yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.nulls(k, pa.int64()), pa.array(v[keep])], ["u", "links", "v"])


def _join(blocks: DataFrame, sent, cells: dict[int, tuple[int, float]], r: float, c: float) -> DataFrame:
    """Rows (u, links, null): links of a class to other classes, to be summed; rows (u, null, v): edges of a spanning forest.

    Pairs of blocks are a product of a written table with itself, so vectors are read again and never shuffled.
    """
    reaches = {j: x[1] for j, x in cells.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                cell, block, dim, to = (batch.column(x)[k].as_py() for x in (0, 1, 2, 5))
                first, pivots = sent.value[dim]
                if (cell, block) != key:
                    if now is not None:
                        yield from now.done()
                    ids = np.frombuffer(batch.column(3)[k].as_py(), np.int64)
                    key, now = (cell, block), _Block(ids, _unit_rows(batch.column(4)[k].as_py(), dim, len(ids)))
                cls, n = (np.frombuffer(batch.column(x)[k].as_py(), np.int64) for x in (6, 7))
                vec = _unit_rows(batch.column(8)[k].as_py(), dim, len(cls))
                if to != cell:
                    own, other = (pivots[x - first : x - first + 1] for x in (to, cell))
                    mine, d, between = _distances(vec, own)[:, 0], _distances(vec, other)[:, 0], max(_distances(own, other)[0, 0], 1e-12)
                    may = (d <= r + reaches[cell] + SLACK) & (d - mine <= 2 * r + SLACK) & ((d * d - mine * mine) / (2 * between) <= r + SLACK)
                    if not may.all():
                        cls, n, vec = cls[may], n[may], vec[may]
                for s in range(0, len(cls), STREAM):
                    now.meet(cls[s : s + STREAM], n[s : s + STREAM], vec[s : s + STREAM], c)
        if now is not None:
            yield from now.done()

    left = blocks.select("cell", "block", "dim", "cls", "vec", "near")
    right = blocks.select(F.col("cell").alias("to"), F.col("cls").alias("other"), F.col("n").alias("times"), F.col("vec").alias("parts"))
    pairs = left.join(right.hint("shuffle_replicate_nl"), F.array_contains("near", F.col("to")))
    return pairs.select("cell", "block", "dim", "cls", "vec", "to", "other", "times", "parts").mapInArrow(run, "u long, links long, v long")


@contextmanager
def _few_rows(spark):
    """Arrow batches of few rows while a table of pairs of blocks is written: such a row holds megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def link_vectors(frame: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = frame.sparkSession
    units = _units(frame.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")))
    base = cut(units.select("vec_id", "cls"), "vectors")
    classes = cut(
        units.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "vector-classes"
    )
    total = classes.count()
    block = min(LARGEST_BLOCK, max(LEAST_BLOCK, -(-total // LEAST_CELLS)))
    sizes = {int(d): int(n) for d, n in classes.groupBy("dim").count().collect()}
    pivots, first = {}, 0
    for dim, n in sorted(sizes.items()):
        most = max(1, min(PIVOT_BYTES // len(sizes) // (8 * dim), -(-n // block)))
        drawn = classes.where(F.col("dim") == dim).select("vec", F.xxhash64("cls").alias("h"), "cls").orderBy("h", "cls").limit(most).collect()
        pivots[dim] = (first, _unit_rows(b"".join(x.vec for x in drawn), dim, len(drawn)))
        first += len(drawn)
    sent = spark.sparkContext.broadcast(pivots)
    cells = {x.cell: (x.n, x.reach) for x in _owned(classes, sent).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("reach")).collect()}
    r = math.sqrt(2 - 2 * threshold)
    blocks = cut(_blocks(classes, sent, cells, r, block), "vector-blocks")
    with _few_rows(spark):
        found = cut(_join(blocks, sent, cells, r, threshold), "vector-links")
    release(blocks)
    roots = components(found.where("v is not null").select("u", "v"))
    named = classes.select("cls", "low", "n").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "low", "n", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("least"))
    links = found.where("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    known = named.join(least, "root").join(links, "cls", "left").select("cls", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    return (
        base.select("vec_id", "cls").join(known, "cls", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
