"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

A document's set is its distinct 5-word shingles (a document of 1 to 4 words: its whole sequence as one), as 64-bit
hashes. Documents with equal sets form a class, known by a 64-bit hash of the set and never expanded into pairs.

1. Prefix filter. Two sets of Jaccard similarity t or more share one of the first n - ceil(t n) + 1 shingles under any
   fixed order of shingles. The order puts shingles seen often last (a bounded list of heavy ones; any list is valid),
   then goes by hash. Classes that share a prefix shingle form a tile, cut into bands of size ratio t: similar sets are
   at most one band apart. The members of a hot shingle are dealt over several tasks, whose sums name the tile.
2. Each member of a tile is first compared with its band's leader and its neighbour in size: a linear number of pairs.
3. What is still apart then meets in bands (each with itself and with the next) split into blocks of bounded size: sizes
   and the bit counts of parity bitmaps (2 bits a shingle or more; popcount(x xor y) <= |x minus y| + |y minus x|) bound
   the overlap from above, for all pairs between different components, without writing a pair that the bound excludes.
4. Pairs left are verified by intersecting sorted arrays; arrays are made again from the texts of the few documents
   needed, so that no shingle table is stored.

Every pair of different components that shares a prefix shingle is tested, so components are exact but for two different
sets or shingles of one 64-bit hash (a chance near n^2 / 2^65). Nulls and empty texts: an empty set, linked with nothing.
Texts of any length are read whole. Repeated rows and copies: one class. Ties: the least id names a component. Empty
tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .store import cut, release, shared_folder

_U = np.uint64
HEAVY_MOST = 1 << 20
HEAVY_LEAST = 32
LOCAL_LEAST = 4
WINDOW = 1 << 21
BLOCK = 1024
SALT = 64
HOT, CHUNK = 4096, 2048
PART = 4096
BITS_EACH = 2
BLOOM_BITS = 1 << 25


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, rows = tk.ngrams(*tk.words(raw, offsets), n)
    out = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        s = np.sort(h[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
    return out


def set_class(s: np.ndarray) -> int:
    """A 64-bit hash of a sorted set, as a signed number."""
    total = tk.mix(s).sum(dtype=np.uint64, keepdims=True) ^ np.array([len(s) * 0x632BE59BD9B4E019 & (1 << 64) - 1], np.uint64)
    return int(tk.mix(total).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Parity bits of a set: a power of two of at least BITS_EACH bits an element, 64 to 2**16 bits."""
    width = 1 << min(16, max(6, math.ceil(math.log2(BITS_EACH * max(len(s), 1)))))
    odd = np.bincount((s >> _U(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (64-bit words in the last axis) folded to fewer words; parities add up."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def most_overlap(na, nb, xor_bits):
    """The overlap's upper bound from set sizes and the bit count of the two bitmaps' xor."""
    return (na + nb - xor_bits) // 2


def similar(na, nb, overlap, percent: int = 80):
    return 100 * overlap >= percent * (na + nb - overlap)


def prefix(s: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 elements in the order: not heavy before heavy, then by hash."""
    n = len(s)
    p = n - (n * percent + 99) // 100 + 1
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        hot = heavy[at] == s
        if hot.any():
            s = np.concatenate([s[~hot], s[hot]])
    return s[:p]


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (kind 0: id, class, size, bitmap) and of shingles seen often in a window (kind 1: hash, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held = [], 0

        def heavy():
            s = np.sort(np.concatenate(window))
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            count = np.diff(np.append(first, len(s)))
            keep = count >= LOCAL_LEAST
            k = int(keep.sum())
            return rows(np.ones(k, np.int32), s[first[keep]].view(np.int64), None, count[keep], [None] * k)

        def rows(kind, key, cls, size, bits):
            return pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(cls, pa.int64()) if cls is not None else pa.nulls(len(key), pa.int64()), pa.array(size, pa.int64()), pa.array(bits, pa.binary())],
                ["kind", "key", "cls", "size", "bits"],
            )

        for part in tk.slices(batches, "text"):
            sets = shingle_sets(*tk.string_buffers(part.column(1)), n)
            yield rows(np.zeros(len(sets), np.int32), part.column(0), [set_class(s) if len(s) else None for s in sets], [len(s) for s in sets], [bitmap(s) if len(s) else None for s in sets])
            window += [s for s in sets if len(s)]
            held += sum(map(len, sets))
            if held >= WINDOW:
                yield heavy()
                window, held = [], 0
        if window:
            yield heavy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind int, key long, cls long, size long, bits binary")


@dataclass
class Heavy:
    """Shingles seen often, sorted; how many tasks share the members of each (1: not hot)."""

    keys: np.ndarray
    chunks: np.ndarray


def _heavy(counts: DataFrame) -> Heavy:
    """Keys of the highest counts, HEAVY_MOST at most: by a histogram of counts, so that nothing is sorted in one task."""
    step = F.floor(F.log2("c") * 8)
    sizes = {r[0]: r[1] for r in counts.groupBy(step.alias("s")).count().collect()}
    kept, least = 0, None
    for s in sorted(sizes, reverse=True):
        if kept + sizes[s] > HEAVY_MOST:
            break
        kept, least = kept + sizes[s], s
    if least is None:
        return Heavy(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    got = counts.where(step >= least).select("key", "c").toArrow()
    keys, c = got["key"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(keys)
    return Heavy(keys[order], np.where(c >= HOT, -(-c // CHUNK), 1)[order])


def _postings(docs: DataFrame, heavy, n: int, percent: int) -> DataFrame:
    """(h, cls, size, chunk) of prefix shingles; chunk: the task's share of a hot shingle, -1 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, done = heavy.value.keys, set()
        hot, chunks = every[heavy.value.chunks > 1], heavy.value.chunks[heavy.value.chunks > 1]
        for part in tk.slices(batches, "text"):
            hs, cs, ns = [], [], []
            for s in shingle_sets(*tk.string_buffers(part.column(0)), n):
                if len(s) and (c := set_class(s)) not in done:
                    if len(done) < 1 << 18:
                        done.add(c)
                    p = prefix(s, every, percent)
                    hs.append(p)
                    cs.append(np.full(len(p), c, np.int64))
                    ns.append(np.full(len(p), len(s), np.int32))
            if hs:
                h, c, chunk = np.concatenate(hs), np.concatenate(cs), np.full(sum(map(len, hs)), -1, np.int32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    is_hot = np.flatnonzero(hot[at] == h)
                    chunk[is_hot] = tk.mix(c[is_hot].view(np.uint64)) % chunks[at[is_hot]].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(np.concatenate(ns)), pa.array(chunk)], ["h", "cls", "size", "chunk"])

    return docs.select("text").mapInArrow(run, "h long, cls long, size int, chunk int")


_ROW = [("kind", "int"), ("h", "long"), ("chunk", "int"), ("tile", "long"), ("cls", "long"), ("size", "int"), ("leader", "long"), ("prev", "long"), ("band", "int"), ("own", "long"), ("below", "long"), ("above", "long"), ("total", "long")]
_ARROW = {"int": pa.int32(), "long": pa.int64()}
MEMBER, SUM, BAND = 0, 1, 2


def bands(size: np.ndarray, percent: int) -> np.ndarray:
    """Band numbers of set sizes: similar sizes are at most one band apart (a hair wider than the ratio, for rounding)."""
    return np.floor(np.log(size) / (math.log(100 / percent) + 1e-9)).astype(np.int64) if percent < 100 else size.astype(np.int64)


def _members(h, c, s, chunk, percent: int) -> Iterator[dict]:
    """Rows of whole (shingle, chunk) groups: members, and for hot shingles the sums and band counts of a chunk."""
    dup = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])
    h, c, s, chunk = h[~dup], c[~dup], s[~dup], chunk[~dup]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (chunk[1:] != chunk[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(h)))
    group = np.repeat(np.arange(len(first)), count)
    signs = tk.mix(c.view(np.uint64))
    sums, hot = np.add.reduceat(signs, first), chunk[first] >= 0
    band = bands(s, percent)
    cell = group * (1 << 32) + band
    start = np.concatenate([[True], cell[1:] != cell[:-1]])
    begin = np.flatnonzero(start)
    each, kinds = np.diff(np.append(begin, len(h))), cell[begin]
    at = np.repeat(np.arange(len(begin)), each)
    down = np.concatenate([[0], np.where(kinds[1:] == kinds[:-1] + 1, each[:-1], 0)])
    up = np.concatenate([np.where(kinds[1:] == kinds[:-1] + 1, each[1:], 0), [0]])
    prev = np.where(~new & (np.roll(s, 1).astype(np.int64) * 100 >= s.astype(np.int64) * percent), np.roll(c, 1), c)
    tile = tk.mix(sums + count.astype(np.uint64)).view(np.int64)
    keep = hot[group] | (count[group] > 1)
    rows = {"h": h, "chunk": chunk, "tile": tile[group], "cls": c, "size": s, "leader": c[begin[at]], "prev": prev, "band": band, "own": each[at], "below": down[at], "above": up[at], "total": count[group]}
    yield {k: v[keep] for k, v in rows.items()} | {"kind": np.full(int(keep.sum()), MEMBER)}
    if hot.any():
        yield {"kind": np.full(int(hot.sum()), SUM), "h": h[first[hot]], "chunk": chunk[first[hot]], "tile": np.bitwise_xor.reduceat(signs, first)[hot].view(np.int64), "total": count[hot]}
        some = begin[hot[group[begin]]]
        yield {"kind": np.full(len(some), BAND), "h": h[some], "chunk": chunk[some], "band": band[some], "own": each[at[some]]}


def _tiles(postings: DataFrame, percent: int) -> DataFrame:
    """Tiles of two classes or more: (tile, cls, size, leader, prev, band, own, below, above, total).

    A tile is known by a hash of its members. own, below, above: how many members its band, the next smaller and the next
    larger one hold; total: all members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        done: set[int] = set()

        def out(pieces):
            for rows in _members(*(np.concatenate(x) for x in zip(*pieces, strict=True)), percent):
                n = len(rows["kind"])
                if n and rows["kind"][0] == MEMBER:  # a tile met before in this task is left out
                    fresh = np.ones(n, bool)
                    edge = np.flatnonzero(np.concatenate([[True], (rows["h"][1:] != rows["h"][:-1]) | (rows["chunk"][1:] != rows["chunk"][:-1])]))
                    for a, b in zip(edge, np.append(edge[1:], n), strict=True):
                        if rows["chunk"][a] < 0:
                            t = int(rows["tile"][a])
                            if t in done:
                                fresh[a:b] = False
                            elif len(done) < 1 << 20:
                                done.add(t)
                    rows = {k: v[fresh] for k, v in rows.items()}
                    n = len(rows["kind"])
                for at in range(0, n, 1 << 16):
                    cols = {k: v[at : at + (1 << 16)] for k, v in rows.items()}
                    size = len(cols["kind"])
                    yield pa.RecordBatch.from_arrays([pa.array(cols[k].astype(np.int32 if t == "int" else np.int64)) if k in cols else pa.nulls(size, _ARROW[t]) for k, t in _ROW], [k for k, _ in _ROW])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            h, chunk = cols[0], cols[3]
            inside = np.flatnonzero((h != h[-1]) | (chunk != chunk[-1]))
            edge = int(inside[-1]) + 1 if len(inside) else 0  # the last group may go on
            if held and (edge or held[-1][0][-1] != h[0] or held[-1][3][-1] != chunk[0]):
                same = int(np.searchsorted(((h != held[-1][0][-1]) | (chunk != held[-1][3][-1])), True)) if held[-1][0][-1] == h[0] and held[-1][3][-1] == chunk[0] else 0
                yield from out(held + ([[x[:same] for x in cols]] if same else []))
                cols, held, edge = [x[same:] for x in cols], [], edge - same
            if edge > 0:
                yield from out([[x[:edge] for x in cols]])
                cols = [x[edge:] for x in cols]
            if len(cols[0]):
                held.append(cols)
        if held:
            yield from out(held)

    dealt = postings.repartition("h", "chunk").sortWithinPartitions("h", "chunk", "size", "cls")
    raw = cut(dealt.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in _ROW)), "tile-members")
    names = ["tile", "cls", "size", "leader", "prev", "band", "own", "below", "above", "total"]
    sums = raw.where(F.col("kind") == SUM).groupBy("h").agg(F.bit_xor("tile").alias("signs"), F.sum("total").alias("total"), F.max("chunk").alias("last"))
    counts = raw.where(F.col("kind") == BAND).groupBy("h", "band").agg(F.sum("own").alias("own"))
    near = lambda step, name: counts.select("h", (F.col("band") + step).alias("band"), F.col("own").alias(name))
    whole = (
        counts.join(near(1, "below"), ["h", "band"], "left").join(near(-1, "above"), ["h", "band"], "left").na.fill(0, ["below", "above"]).join(sums.where("total > 1"), "h")
        .withColumn("tile", F.xxhash64("signs", "total")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("signs", "last")
    )
    member = raw.where(F.col("kind") == MEMBER)
    hot = member.where("chunk >= 0").select("h", "chunk", "band", "cls", "size", "leader", "prev").join(whole, ["h", "band", "chunk"])
    found = member.where("chunk < 0").select(*names).unionByName(hot.select(*names))
    tiles = cut(found.groupBy("tile", "cls").agg(*[F.min(c).alias(c) for c in names[2:]]), "tiles")
    release(raw)
    return tiles


def _ordered(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b")


def _bitmap_pass(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow the similarity."""
    bits = classes.select("cls", "size", "bits")
    both = (
        pairs.join(bits.select(F.col("cls").alias("a"), F.col("size").alias("na"), F.col("bits").alias("xa")), "a")
        .join(bits.select(F.col("cls").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("xb")), "b")
        .where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            wide = np.stack([pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False) // 8 for k in (4, 5)], axis=1)
            xor = np.zeros(len(na), np.int64)
            for p, q in np.unique(wide, axis=0):  # bitmaps of one width each, folded together
                i = np.flatnonzero((wide == (p, q)).all(axis=1))
                x, y = (np.frombuffer(b"".join(batch.column(k).take(pa.array(i)).to_pylist()), np.uint64).reshape(len(i), -1) for k in (4, 5))
                xor[i] = np.bitwise_count(fold(x, min(p, q)) ^ fold(y, min(p, q))).sum(axis=1)
            keep = pa.array(similar(na, nb, most_overlap(na, nb, xor), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def _block_pairs(tiles: DataFrame, roots: DataFrame, classes: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs of different components that the bounds allow, from tiles split into blocks; the ``best`` of any two components in a block, or all."""
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("total") / F.lit(PART))).cast("int")
    apart = tiles.join(roots, F.col("cls") == F.col("node"), "left").select("tile", part.alias("part"), "cls", "band", "own", "below", "above", "total", F.coalesce("root", "cls").alias("root"))
    mixed = (
        apart.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("total").alias("total")).where("lo < hi")
        .select("tile", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / F.lit(PART)).cast("int") - 1)).alias("part"))
    )
    apart = apart.join(mixed, ["tile", "part"], "left_semi").join(classes.select("cls", "size", "bits"), "cls")
    of = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("cls", F.lit(7)), of("own")).cast("int")

    def meets(n: str, lo, i, j):
        """The groups in which a member meets the blocks of a band that holds ``n`` members."""
        at = F.when(F.col(n) > 0, F.sequence(F.lit(0), of(n) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.struct(lo.cast("int").alias("lo"), F.lit(int(n != "own")).alias("cross"), i(k).alias("i"), j(k).alias("j")))

    alone = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("cross"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    each = F.when(F.col("total") <= BLOCK, alone).otherwise(F.concat(  # a tile that fits a block is one group
        meets("own", F.col("band"), lambda k: F.least(block, k), lambda k: F.greatest(block, k)),
        meets("above", F.col("band"), lambda k: block, lambda k: k),
        meets("below", F.col("band") - 1, lambda k: k, lambda k: block),
    ))
    dealt = apart.withColumn("pair", F.explode(each)).select("tile", "pair.lo", "pair.cross", "pair.i", "pair.j", block.alias("block"), "band", "cls", "size", "root", "bits")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size, root, cls, block, band = (table.column(c).to_numpy() for c in ("size", "root", "cls", "block", "band"))
        order = np.lexsort((cls, size))
        bits = table.column("bits").to_pylist()
        words = [np.frombuffer(bits[k], np.uint64) for k in order]
        size, root, cls, side = size[order].astype(np.int64), root[order], cls[order], (band if key[2].as_py() else block)[order]
        whole = not key[2].as_py() and key[3].as_py() == key[4].as_py()  # one block with itself
        a, b, lead = [], [], []
        for width in sorted({len(w) for w in words}):  # partners of each bitmap width, the smaller of the two
            wide = np.array([k for k, w in enumerate(words) if len(w) >= width])
            folded = np.stack([fold(words[k], width) for k in wide])
            sizes, roots_of, sides = size[wide], root[wide], side[wide]
            last = np.searchsorted(sizes * percent, sizes * 100, "right")  # partners are at least as large, and not too large
            for p in range(len(wide)):
                if len(words[wide[p]]) > width or last[p] <= p + 1:
                    continue
                at = slice(p + 1, last[p])
                other = roots_of[at] != roots_of[p]
                near = p + 1 + np.flatnonzero(other if whole else other & (sides[at] != sides[p]))
                if len(near):
                    xor = np.bitwise_count(folded[near] ^ folded[p]).sum(axis=1, dtype=np.int64)
                    most = most_overlap(sizes[near], sizes[p], xor)
                    fits = similar(sizes[near], sizes[p], most, percent)
                    good = wide[near[fits]]
                    a.append(np.full(len(good), wide[p]))
                    b.append(good)
                    lead.append((most / (sizes[near] + sizes[p] - most))[fits])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if best and len(a):
            lead = np.concatenate(lead)
            lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            order = np.lexsort((-lead, hi, lo))
            first = np.concatenate([[True], (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])])
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            a, b = a[order[rank < best]], b[order[rank < best]]
        a, b = cls[a], cls[b]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("tile", "lo", "cross", "i", "j").applyInArrow(run, "a long, b long")


def _bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of a fixed 4 MB over long keys (three probes); made on executors, joined by a bitwise or."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[at] = True
        packed = np.packbits(bits).reshape(256, -1)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([packed[k].tobytes() for k in used], pa.binary())], ["part", "bits"])

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = np.bitwise_or.reduce(np.stack([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]), axis=0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([x.tobytes()], pa.binary())})

    out = np.zeros((256, BLOOM_BITS // 8 // 256), np.uint8)
    for row in keys.coalesce(12).mapInArrow(run, "part int, bits binary").groupBy("part").applyInArrow(join, "part int, bits binary").collect():
        out[row[0]] = np.frombuffer(row[1], np.uint8)
    return out.reshape(-1)


def _probes(keys: np.ndarray):
    x = keys.view(np.uint64)
    return [(tk.mix(x + _U(k * 0x9E3779B9)) >> _U(39)).astype(np.int64) for k in (1, 2, 3)]


def _standing(batches: Iterator[pa.RecordBatch], bloom: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) whose id the filter holds or is null."""
    for batch in batches:
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        keep = np.ones(len(ids), bool)
        for at in _probes(ids):
            keep &= (bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        keep |= batch.column(0).is_null().to_numpy(zero_copy_only=False)
        if keep.any():
            yield batch.filter(pa.array(keep))


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar, by exact intersection of their shingle arrays.

    Only the documents that stand for a class needed (by a Bloom filter over their ids, and rows without an id) are read again.
    """
    needed = cut(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "needed")
    standing = needed.join(classes.select("cls", "low"), "cls").where("low is not null").select("low")
    sent = docs.sparkSession.sparkContext.broadcast(_bloom(standing))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, done = sent.value, set()
        for part in tk.slices(_standing(batches, bloom), "text"):
            cls, arr = [], []
            sets = [s for s in shingle_sets(*tk.string_buffers(part.column(1)), n) if len(s)]
            ids = [set_class(s) for s in sets]
            for k in range(len(ids)):
                if (c := ids[k]) not in done:
                    if len(done) < 1 << 18:
                        done.add(c)
                    cls.append(c)
                    arr.append(sets[k].tobytes())
            if cls:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(arr, pa.large_binary()).cast(pa.binary())], ["cls", "arr"])

    sets = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(arrays, "cls long, arr binary").join(needed, "cls", "left_semi").groupBy("cls").agg(F.first("arr").alias("arr"))
    sets = cut(sets, "shingle-arrays")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT)).cast("int").alias("blocks"))
    members = (
        pairs.join(blocks, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
        .join(sets.select(F.col("cls").alias("b"), "arr"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "arr")
    )
    leaders = (
        blocks.join(sets.select(F.col("cls").alias("a"), "arr"), "a")
        .select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "arr")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a_out, b_out = [], []
            for a, kind, b, arr in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                s = np.frombuffer(arr, np.uint64)
                if kind == 0:
                    lead, own = a, s
                elif lead == a:
                    small, large = (s, own) if len(s) <= len(own) else (own, s)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    if similar(len(s), len(own), int((large[at] == small).sum()), percent):
                        a_out.append(a)
                        b_out.append(b)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["u", "v"])

    dealt = members.unionByName(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    links = cut(dealt.mapInArrow(meet, "u long, v long"), "links")
    release(sets, needed)
    return links


def jaccard_components(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the least id reachable by links."""
    spark = docs.sparkSession
    shared_folder(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    described = cut(_describe(docs, n), "shingle-sets")
    rows = described.where("kind = 0")
    sent = spark.sparkContext.broadcast(_heavy(described.where("kind = 1").groupBy("key").agg(F.sum("size").alias("c")).where(F.col("c") >= HEAVY_LEAST)))
    classes = cut(rows.where("cls is not null").groupBy("cls").agg(F.min("key").alias("low"), F.first("size").alias("size"), F.first("bits").alias("bits")), "classes")
    tiles = _tiles(_postings(docs, sent, n, percent), percent)
    stars = _ordered(tiles, "leader", "cls").union(_ordered(tiles, "prev", "cls")).distinct()
    pairs = cut(_bitmap_pass(stars, classes, percent), "pairs")
    links, tried, further = [_verify(pairs, docs, classes, n, percent)], stars, []
    roots = cut(components(links[0]), "roots")
    for best in (2, None):
        more = cut(_block_pairs(tiles, roots, classes, percent, best).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        further.append(more)
        if more.isEmpty():
            continue
        links.append(_verify(more, docs, classes, n, percent))
        tried = tried.union(more)
        release(roots)
        every = links[0]
        for part in links[1:]:
            every = every.union(part)
        roots = cut(components(every), "roots")
    release(pairs, tiles, *links, *further)
    low = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    least = low.groupBy("root").agg(F.min("low").alias("component_id"))
    named = low.join(least, "root").select("cls", "component_id")
    return (
        rows.select(F.col("key").alias("doc_id"), F.col("size").alias("n_shingles"), "cls").join(named, "cls", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def keep_representatives(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: the document with the least id, and of repeated rows (same id and text) the first.

    Ids name documents: rows that share an id are kept or dropped together. Rows with a null id are kept.
    """
    gone_id, again_id = (next(f"{x}{k or ''}" for k in range(len(docs.columns) + 1) if f"{x}{k or ''}" not in docs.columns) for x in ("gone", "again"))
    found = jaccard_components(docs, percent, n, id_col, text_col)
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "near-copies")
    kept = docs.join(gone, docs[id_col].cast("long") == gone[gone_id], "left_anti")
    again = docs.groupBy(F.col(id_col).alias(again_id)).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).where(F.col(again_id).isNotNull()).select(again_id)
    if again.isEmpty():
        return kept
    again = cut(again, "repeated-ids")
    once = kept.join(again, kept[id_col] == again[again_id], "left_anti")
    rest = kept.join(again, kept[id_col] == again[again_id], "left_semi")
    return once.unionByName(rest.dropDuplicates([id_col, text_col]))
