"""Ranked lexical search: Block-Max WAND over an inverted index in shards.

A shard is a run of documents of one partition (SHARD_WORDS words or SHARD_DOCS documents), numbered by ascending id. A
term's postings lie in blocks of BLOCK: the gaps between document numbers and the term frequencies, each in 1, 2 or 4
bytes, compressed apart; a block's first and last document, widths and largest impact lie in a directory, uncompressed. A
query first moves over the directories only (shallow moves): between two block ends the sum of the largest impacts of the
blocks there bounds every document's score. Where it is below the threshold (the k-th best score so far) the pointers skip
on, and nothing is decompressed. Elsewhere, a stretch of surviving places at a time, document numbers are decompressed; a
document whose own blocks' maxima add up to the threshold is a pivot, and only pivots' frequencies are decompressed and
scored. In blocks that reach over more than SPARSE places a posting, pointers move by document, not by block, or one rare term
would keep up the bound of a whole shard. The places with the highest bounds come first, so that the threshold is high before the sweep. Skipping needs a
bound strictly below the threshold, so ties at it are kept, and the result is exact.

Terms are known by 64-bit hashes; see ``textkit``. Counts of the corpus are taken from all documents. The index is written
in the shared folder, its terms' rows are joined with those asked for, and each shard is searched by one task. Queries are
dealt into passes of at most PASS_BYTES, measured; each pass reads the postings asked for once.

Null texts, and texts without a term, are not documents of the ranking, and as items they find nothing. Texts of any length
are whole documents, at worst a shard of their own. Ties are ordered by ascending id, null ids last. Repeated documents
are ranked each, repeated items get their own ranking each; an item without an id is answered under a null id. An empty
table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .passes import deal
from .store import cut, release

BLOCK = 128
SHARD_WORDS = 4 << 20
SHARD_DOCS = 1 << 16
PASS_BYTES = 32 << 20
SEED, STRETCH = 16, 64
SPARSE = 32
POSTINGS = "shard long, term long, df int, first binary, last binary, peak binary, widths binary, data binary, ids binary, norms binary"
_NAMES = [x.split()[0] for x in POSTINGS.split(", ")]


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by: 64-bit integers, rounded down."""
    return (1000000000 * tf) // (1000 * tf + 8 * norm)


def _cells(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Byte cells of contiguous data, cut at n+1 byte offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))]).cast(pa.binary())


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.int64)


def _store(data: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for k in range(4):
        i = slice(None) if k == 0 else np.flatnonzero(width > k)
        data[at[i] + k] = (values[i] >> (8 * k)) & 255


def _load(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = data[at].astype(np.int64)
    for k in range(1, 4):
        i = np.flatnonzero(width > k)
        out[i] |= data[at[i] + k].astype(np.int64) << (8 * k)
    return out


def build_shard(hashes: np.ndarray, doc: np.ndarray, norms: np.ndarray) -> dict[str, object]:
    """Columns df, first, last, peak, widths, data by term; ``doc`` is the document number of each word."""
    terms, of = np.unique(hashes, return_inverse=True)
    key = np.sort(of.astype(np.int64) * len(norms) + doc)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(start, len(key)))
    term, doc = np.divmod(key[start], len(norms))
    at = np.searchsorted(term, np.arange(len(terms) + 1))
    place = np.arange(len(term)) - at[term]
    opens = np.flatnonzero(place % BLOCK == 0)
    size = np.diff(np.append(opens, len(term)))
    block = np.repeat(np.arange(len(opens)), size)
    gap = np.diff(doc, prepend=0)
    gap[opens] = 0
    gap_width, tf_width = _width(np.maximum.reduceat(gap, opens)), _width(np.maximum.reduceat(tf, opens))
    bytes_of = size * (gap_width + tf_width)
    from_ = np.cumsum(bytes_of) - bytes_of
    data = np.zeros(int(bytes_of.sum()), np.uint8)
    nth = np.arange(len(term)) - opens[block]
    _store(data, from_[block] + nth * gap_width[block], gap, gap_width[block])
    _store(data, from_[block] + size[block] * gap_width[block] + nth * tf_width[block], tf, tf_width[block])
    peak = np.maximum.reduceat(impact(tf, norms[doc]), opens).astype(np.int32)
    blocks_at = np.searchsorted(term[opens], np.arange(len(terms) + 1))
    last = doc[np.append(opens[1:], len(term)) - 1].astype(np.int32)
    widths = np.stack([gap_width, tf_width], axis=1).astype(np.uint8)
    return {
        "term": terms.view(np.int64), "df": np.diff(at).astype(np.int32), "first": _cells(doc[opens].astype(np.int32), blocks_at * 4), "last": _cells(last, blocks_at * 4),
        "peak": _cells(peak, blocks_at * 4), "widths": _cells(widths, blocks_at * 2), "data": _cells(data, np.append(from_, len(data))[blocks_at]),
    }


def _index(docs: DataFrame, total: int, words: int) -> DataFrame:
    """Postings of all terms, and for each shard a row of its documents' ids and norms under a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = (TaskContext.get().partitionId() << 24) - 1, []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, shard
            shard += 1
            ids, known, n, h = (np.concatenate(c) for c in zip(*held, strict=True))
            held = []
            order = np.lexsort((ids, ~known))
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            norms = 10 + (90 * n[order] * total) // words
            got = build_shard(h, np.repeat(number, n), norms)
            count = len(got["df"])
            nothing = pa.nulls(count, pa.binary())
            rows = pa.RecordBatch.from_arrays([pa.array(np.full(count, shard)), *(pa.array(got[c]) if isinstance(got[c], np.ndarray) else got[c] for c in _NAMES[1:8]), nothing, nothing], _NAMES)
            for at in range(0, count, 8192):
                yield rows.slice(at, 8192)
            cell = lambda x: pa.array([x.tobytes()], pa.binary())
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.nulls(1, pa.int64()), pa.array([len(ids)], pa.int32()), none, none, none, cell(known[order]), none, cell(ids[order]), cell(norms)], _NAMES
            )

        for part in tk.slices(batches, "text"):
            h, rows = tk.words(*tk.string_buffers(part.column(1)), letters=True)
            n = np.diff(rows)
            has = n > 0
            if not has.any():
                continue
            known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            held.append((part.column(0).fill_null(0).to_numpy()[has], known[has], n[has], h))
            if sum(len(x[3]) for x in held) >= SHARD_WORDS or sum(len(x[0]) for x in held) >= SHARD_DOCS:
                yield from out()
        if held:
            yield from out()

    return docs.mapInArrow(run, POSTINGS)


class Shard:
    """The postings asked for of one shard: directories as arrays over all their blocks, data still compressed."""

    def __init__(self, rows: list[dict]):
        of = next(x for x in rows if x["term"] is None)
        self.ids, self.known, self.norms = np.frombuffer(of["ids"], np.int64), np.frombuffer(of["widths"], bool), np.frombuffer(of["norms"], np.int64)
        rows = [x for x in rows if x["term"] is not None]
        join = lambda c, kind: np.frombuffer(b"".join(x[c] for x in rows), kind)
        self.first, self.last, self.peak = (join(c, np.int32).astype(np.int64) for c in ("first", "last", "peak"))
        self.widths = join("widths", np.uint8).reshape(-1, 2).astype(np.int64)
        self.data = join("data", np.uint8)
        blocks = np.array([len(x["first"]) // 4 for x in rows], np.int64)
        ends = np.cumsum(blocks)
        self.at = {x["term"]: (int(e - n), int(e)) for x, e, n in zip(rows, ends, blocks, strict=True)}
        self.size = np.full(len(self.first), BLOCK, np.int64)
        for x, e in zip(rows, ends, strict=True):
            self.size[e - 1] = (x["df"] - 1) % BLOCK + 1
        bytes_of = self.size * self.widths.sum(axis=1)
        self.from_ = np.cumsum(bytes_of) - bytes_of
        self.decompressed = 0  # blocks, for tests

    def documents(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers of these blocks' postings, and which block each is of."""
        self.decompressed += len(blocks)
        size, width = self.size[blocks], self.widths[blocks, 0]
        of = np.repeat(np.arange(len(blocks)), size)
        opens = np.cumsum(size) - size
        nth = np.arange(len(of)) - opens[of]
        steps = np.cumsum(_load(self.data, self.from_[blocks][of] + nth * width[of], width[of]))
        return self.first[blocks][of] + steps - steps[opens][of], of

    def frequencies(self, blocks: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Frequency of the nth posting of each of these blocks."""
        width = self.widths[blocks, 1]
        return _load(self.data, self.from_[blocks] + self.size[blocks] * self.widths[blocks, 0] + nth * width, width)

    def top(self, terms: list[int], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (document numbers, scores), ties by number."""
        spans = [(*self.at[t], w) for t, w in zip(terms, weights, strict=True) if t in self.at and w > 0]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not spans:
            return docs, scores
        blocks = np.concatenate([np.arange(a, b) for a, b, _ in spans])
        weight = np.repeat([w for _, _, w in spans], [b - a for a, b, _ in spans])
        bound = self.peak[blocks] * weight
        # blocks that reach far for their postings: their pointers go from document to document
        far = self.last[blocks] - self.first[blocks] >= SPARSE * self.size[blocks]
        thin, blocks, thin_weight, weight = blocks[far], blocks[~far], weight[far], weight[~far]
        thin_doc, thin_of = self.documents(thin)
        thin_nth = np.arange(len(thin_of)) - np.searchsorted(thin_of, np.arange(len(thin)))[thin_of]
        thin_bound, bound = bound[far][thin_of], bound[~far]
        # shallow moves: what bounds a score between one block end and the next
        first, last = self.first[blocks], self.last[blocks]
        turns = np.concatenate([first, thin_doc, last + 1, thin_doc + 1])
        order = np.argsort(turns, kind="stable")
        turns, sums = turns[order], np.cumsum(np.concatenate([bound, thin_bound, -bound, -thin_bound])[order])
        begins = np.flatnonzero(np.append(turns[1:] != turns[:-1], False))
        place, until, most = turns[begins], turns[begins + 1], sums[begins]
        least, left = 1, most > 0

        def visit(places: np.ndarray) -> None:
            nonlocal docs, scores, least
            left[places] = False
            a, b = place[places], until[places]

            def inside(doc: np.ndarray) -> np.ndarray:
                i = np.searchsorted(a, doc, "right") - 1
                return np.flatnonzero((i >= 0) & (doc < b[np.maximum(i, 0)]))

            i = np.searchsorted(b, first, "right")
            near = np.flatnonzero((i < len(a)) & (a[np.minimum(i, len(a) - 1)] <= last))
            doc, of = self.documents(blocks[near])
            nth = np.arange(len(of)) - np.searchsorted(of, np.arange(len(near)))[of]
            dense, sparse = inside(doc), inside(thin_doc)
            of, doc, nth = near[of[dense]], np.concatenate([doc[dense], thin_doc[sparse]]), np.concatenate([nth[dense], thin_nth[sparse]])
            block, times = np.concatenate([blocks[of], thin[thin_of[sparse]]]), np.concatenate([weight[of], thin_weight[thin_of[sparse]]])
            seen, doc = np.unique(doc, return_inverse=True)
            take = (np.bincount(doc, np.concatenate([bound[of], thin_bound[sparse]]), len(seen)) >= least)[doc]  # pivots
            doc = doc[take]
            tf = self.frequencies(block[take], nth[take])
            got = np.bincount(doc, times[take] * impact(tf, self.norms[seen[doc]]), len(seen)).astype(np.int64)
            keep = got >= least
            docs, scores = np.concatenate([docs, seen[keep]]), np.concatenate([scores, got[keep]])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(scores) == k:
                least = max(least, int(scores[-1]))

        if len(most) > SEED:
            visit(np.sort(np.argpartition(most, len(most) - SEED)[len(most) - SEED :]))
        at = 0
        while True:
            on = np.flatnonzero(left[at:] & (most[at:] >= least))[:STRETCH]
            if not len(on):
                return docs, scores
            on += at
            at = int(on[-1]) + 1
            visit(on)


def _terms(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            h, rows = tk.words(*tk.string_buffers(part.column(2)), letters=True)
            row = tk.row_index(rows)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(h.view(np.int64))], ["item", "item_id", "term"])

    return items.mapInArrow(run, "item long, item_id long, term long").distinct()


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and the terms of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = words = 0
        for part in tk.slices(batches, "text"):
            n = np.diff(tk.words(*tk.string_buffers(part.column(0)), letters=True)[1])
            docs, words = docs + int((n > 0).sum()), words + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([words])], ["docs", "words"])

    got = docs.select("text").mapInArrow(run, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    return got[0] or 0, got[1] or 0


def _searched(postings: DataFrame, shards: int, queries: DataFrame, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best k of each shard for each item of one pass; as many tasks as there are shards, dealt by ranges."""
    asked: dict[int, tuple] = {}
    for x in queries.select("item", "item_id", "term", "weight").collect():
        of = asked.setdefault(x["item"], (x.item_id, [], []))
        of[1].append(x.term)
        of[2].append(x.weight)
    sent = postings.sparkSession.sparkContext.broadcast(asked)

    def answer(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        shard = Shard(rows)
        for item, (item_id, terms, weights) in sent.value.items():
            docs, scores = shard.top(terms, weights, k)
            if n := len(docs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(shard.ids[docs], mask=~shard.known[docs]), pa.array(scores)], ["item", "item_id", "doc_id", "score"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if x["shard"] != now:
                    if held:
                        yield from answer(held)
                    now, held = x["shard"], []
                held.append(x)
        if held:
            yield from answer(held)

    return postings.repartitionByRange(max(shards, 1), "shard").sortWithinPartitions("shard").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    terms = _terms(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("item_id"), F.col(query_col).alias("text")))
    terms = cut(terms, "item-terms")
    total, words = _sizes(docs)
    best, count, shards = None, 0, 0
    if total:
        index = cut(_index(docs, total, words), "postings")
        postings = cut(index.join(terms.select("term").distinct(), "term", "left_semi").select(*_NAMES).unionByName(index.where("term is null")), "postings-asked")
        release(index)
        shards = postings.where("term is null").count()
        weight = F.floor(1000 * F.log((2 * F.lit(float(total)) + 2) / (2 * F.col("df") + 1))).cast("long")
        df = postings.where("term is not null").groupBy("term").agg(F.sum("df").cast("double").alias("df")).select("term", weight.alias("weight"))
        queries = cut(terms.join(df, "term").where("weight > 0").withColumn("size", F.lit(32)), "item-weights")
        dealt, count = deal(queries, "item", "size", PASS_BYTES)
    for n in range(count):
        one = _searched(postings, shards, dealt.where(F.col("pass") == n), k)
        if count > 1:
            one = cut(one, "shard-best")
        best = one if best is None else best.unionByName(one)
    if best is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
