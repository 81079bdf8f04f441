"""Benchmark decontamination: a BM25 inverted index of test items with block maxima, queried by every training passage.

The index is made on executors, in shards of at most SHARD items of like length. A shard has postings by item, and by term
the blocks of BLOCK items in which the term occurs, each with the largest impact there. Documents are cut into cells of
CELL words; a passage is a run of cells long enough to hold any item whole, and passages begin at every cell, so no
occurrence is cut. As in block-max WAND, bounds are tried in turn, here for all passages of a batch together: the sum of a
passage's term maxima shows whether there is a pivot at all; where there is, the block maxima of its terms are summed over
the blocks that hold them; only blocks that reach the least threshold in them are scored exactly, from their postings, and
all items at or above their own threshold are retrieved. An item's threshold is its score against itself less its heaviest
fifth of terms, which a passage that keeps 80 % of the item's 5-word shingles can never miss; so pruning loses nothing.

A retrieved item is a leak if 80 % of its shingles occur in the passage, question and answer (its last sentence, or the
last quarter of a single one) together, and each by itself is there by half: of the question's shingles, and of the
answer's words. An answer of fewer than SHINGLE words, which is not a shingle by itself, carries too little weight for
that: there the question counts alone.

Words are runs of letters and digits, A-Z lower-cased, so that case and punctuation do not hide a leak. An item of fewer
than 5 words is one shingle, its whole sequence, and has to occur as such. Items without words are never found; items
without an id are found under a null id; null and empty texts leak nothing; texts of any length are read whole; an empty
benchmark finds nothing; ties of passages go to the larger overlap, then score. Repeated rows are judged alike, repeated
items found each; extra columns are kept by ``clean_documents`` and ignored otherwise. Executors get shards in passes of
at most PASS_BYTES, measured; each pass reads the documents again.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import cut, release

SHARD, BLOCK, CELL, SHINGLE = 1024, 8, 64, 5
SHARD_WORDS = 1 << 18
PASS_BYTES = 64 << 20
EXPAND = 1 << 21
K1, B = 1.2, 0.75


class Lists:
    """Arrays laid end to end."""

    def __init__(self, parts: list[np.ndarray], kind):
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        self.all = np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.all[self.at[k] : self.at[k + 1]]


@dataclass
class Shard:
    """One shard of the index; items and known terms are numbered within it."""

    terms: np.ndarray
    top: np.ndarray  # a term's largest impact
    block_at: np.ndarray  # offsets by term into the next two
    block: np.ndarray
    block_top: np.ndarray  # a term's largest impact in a block
    item_terms: Lists
    item_impacts: Lists
    threshold: np.ndarray
    least: np.ndarray  # a block's least threshold
    ids: list
    shingles: Lists
    questions: Lists
    answers: Lists
    brief: np.ndarray  # whether the answer has fewer than SHINGLE words
    cells: int


_WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def _answer(words: int, text: str) -> int:
    """How many words the answer has: the last sentence, or a quarter of a single sentence."""
    body = text.rstrip().rstrip(".!?")
    cut = max(body.rfind(c) for c in ".!?\n")
    got = len(_WORD.findall(body[cut + 1 :])) if cut >= 0 else 0
    return got if 0 < got < words else max(1, words // 4)


def make_shard(ids: list, texts: list[str], impacts: list[tuple[np.ndarray, np.ndarray]]) -> Shard:
    """From items with words, by length, and the (term hash, impact) arrays of each."""
    h, rows = tk.words(*tk.string_buffers(pa.array(texts, pa.large_string())), letters=True)
    grams, gram_rows = tk.ngrams(h, rows, SHINGLE)
    terms = np.unique(np.concatenate([t for t, _ in impacts]))
    of = [np.searchsorted(terms, t) for t, _ in impacts]
    term, value = np.concatenate(of), np.concatenate([w for _, w in impacts])
    block = np.repeat(np.arange(len(impacts)) // BLOCK, [len(t) for t in of])
    order = np.lexsort((block, term))
    new = np.concatenate([[True], (term[order][1:] != term[order][:-1]) | (block[order][1:] != block[order][:-1])])
    first = np.flatnonzero(new)
    peak = (np.maximum.reduceat(value[order], first) * 1.000001).astype(np.float32)
    begin = np.searchsorted(term[order][first], np.arange(len(terms) + 1))
    size = np.diff(rows)
    threshold = np.array([np.sort(w)[: max(len(w) - int(0.2 * n), 1)].sum() * 0.999999 for (_, w), n in zip(impacts, size, strict=True)])
    answer = [_answer(int(n), t) for n, t in zip(size, texts, strict=True)]
    questions = [h[rows[i] : rows[i + 1] - n] for i, n in enumerate(answer)]
    return Shard(
        terms, np.maximum.reduceat(peak, begin[:-1]), begin, block[order][first].astype(np.int32), peak, Lists(of, np.int32), Lists([w for _, w in impacts], np.float64),
        threshold, np.minimum.reduceat(threshold, np.arange(0, len(ids), BLOCK)), ids,
        Lists([np.unique(grams[a:b]) for a, b in zip(gram_rows[:-1], gram_rows[1:], strict=True)], np.uint64),
        Lists([np.unique(tk.ngrams(q, np.array([0, len(q)]), SHINGLE)[0]) if len(q) >= SHINGLE else q[:0] for q in questions], np.uint64),
        Lists([np.unique(h[rows[i + 1] - n : rows[i + 1]]) for i, n in enumerate(answer)], np.uint64), np.array(answer) < SHINGLE,
        -(-(int(size.max()) - 1) // CELL) + 1,
    )


def _bounds(shard: Shard, h: np.ndarray, cell_of: np.ndarray, cells: int, cell_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, blocks) of passages and blocks whose bounds reach the least threshold there."""

    def passages(bound: np.ndarray) -> np.ndarray:
        total = bound.copy()
        for k in range(1, shard.cells):
            same = cell_row[k:] == cell_row[:-k]
            total[:-k][same] += bound[k:][same]
        return total

    at = np.minimum(np.searchsorted(shard.terms, h), len(shard.terms) - 1)
    known = np.flatnonzero(shard.terms[at] == h)
    key = np.sort(cell_of[known] * len(shard.terms) + at[known])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    cell, term = key // len(shard.terms), key % len(shard.terms)
    live = passages(np.bincount(cell, shard.top[term], minlength=cells)) >= shard.least.min()
    if not live.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wanted = live.copy()
    for k in range(1, shard.cells):
        wanted[k:] |= live[:-k]
    keep = wanted[cell]
    cell, term = cell[keep], term[keep]
    blocks = len(shard.least)
    size = np.diff(shard.block_at)[term]
    done = np.cumsum(size)
    out = np.zeros(cells * blocks, np.float32)
    a = 0
    while a < len(cell):  # a bounded number of (cell, term, block) at a time
        b = max(int(np.searchsorted(done, done[a] - size[a] + EXPAND, "right")), a + 1)
        n = size[a:b]
        where = np.repeat(shard.block_at[term[a:b]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        low, high = int(cell[a]), int(cell[b - 1]) + 1
        at = (np.repeat(cell[a:b], n) - low) * blocks + shard.block[where]
        out[low * blocks : high * blocks] += np.bincount(at, shard.block_top[where], minlength=(high - low) * blocks)
        a = b
    total = passages(out.reshape(cells, blocks))
    return np.nonzero((total >= shard.least) & live[:, None])


def leaks(shards: list[Shard], raw: np.ndarray, offsets: np.ndarray, overlap: float = 0.8) -> list[tuple]:
    """(row, item id, score, overlap of shingles, of the question's, of the answer's words): the best passage of each row and item."""
    h, rows = tk.words(raw, offsets, letters=True)
    n = np.diff(rows)
    per = -(-n // CELL)
    first = np.concatenate([[0], np.cumsum(per)])
    row = tk.row_index(rows)
    cell_of = first[row] + (np.arange(len(h)) - rows[row]) // CELL
    cell_row = np.repeat(np.arange(len(n)), per)
    best: dict[tuple[int, int, int], tuple[float, float, float, float]] = {}
    for s, shard in enumerate(shards):
        if not len(h):
            break
        cells, blocks = _bounds(shard, h, cell_of, int(first[-1]), cell_row)
        at = 0
        while at < len(cells):
            to = int(np.searchsorted(cells, cells[at], "right"))
            c, r = int(cells[at]), int(cell_row[cells[at]])
            a = int(rows[r] + (c - first[r]) * CELL)
            passage = h[a : min(a + shard.cells * CELL, rows[r + 1])]
            seen = np.unique(passage)
            k = np.minimum(np.searchsorted(shard.terms, seen), len(shard.terms) - 1)
            here = np.zeros(len(shard.terms), bool)
            here[k[shard.terms[k] == seen]] = True
            grams = None
            for block in blocks[at:to]:
                for i in range(int(block) * BLOCK, min((int(block) + 1) * BLOCK, len(shard.ids))):
                    score = float(shard.item_impacts[i][here[shard.item_terms[i]]].sum())
                    if score < shard.threshold[i]:
                        continue
                    if grams is None:
                        grams = np.unique(tk.ngrams(passage, np.array([0, len(passage)]), SHINGLE)[0])
                    own, question = shard.shingles[i], shard.questions[i]
                    found = int(np.isin(own, grams).sum())
                    if not found and len(own) == 1:
                        found = _short(own[0], passage)
                    asked = float(np.isin(question, grams).mean()) if len(question) else 1.0
                    share, answer = found / len(own), float(np.isin(shard.answers[i], seen).mean())
                    if share >= overlap and asked >= 0.5 and (answer >= 0.5 or shard.brief[i]):
                        key, now = (r, s, i), (share, score, asked, answer)
                        best[key] = max(best.get(key, now), now)
            at = to
    return [(r, shards[s].ids[i], score, share, asked, answer) for (r, s, i), (share, score, asked, answer) in sorted(best.items())]


def _short(shingle: np.uint64, passage: np.ndarray) -> int:
    """1 if an item of fewer than SHINGLE words occurs as a run in the passage."""
    for n in range(1, SHINGLE):
        if len(passage) >= n:
            runs = np.lib.stride_tricks.sliding_window_view(passage, n).reshape(-1)
            grams = tk.ngrams(np.ascontiguousarray(runs), np.arange(0, len(runs) + 1, n), SHINGLE)[0]
            if (grams == shingle).any():
                return 1
    return 0


@dataclass
class Index:
    """Shards of a benchmark in a written table (number, size, shard), and the passes they are read in."""

    table: DataFrame
    passes: list[list[int]]

    def shards(self, numbers: list[int]) -> list[Shard]:
        got = self.table.where(F.col("number").isin(numbers)).orderBy("number").select("shard").collect()
        return [pickle.loads(bytes(x[0])) for x in got]


def index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Index:
    """The index of a benchmark table, made and kept on executors; the driver sees sizes of shards only."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    items = cut(items.withColumn("no", F.monotonically_increasing_id()), "items")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            h, rows = tk.words(*tk.string_buffers(part.column(1)), letters=True)
            row, n = tk.row_index(rows), np.diff(rows)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
            tf, own = np.diff(np.append(first, len(h))), row[first]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(n[own]), pa.array(h[first].view(np.int64)), pa.array(tf)], ["no", "n", "term", "tf"])

    rows = cut(items.select("no", "text").mapInArrow(terms, "no long, n long, term long, tf long"), "item-terms")
    sizes = rows.groupBy("no").agg(F.first("n").alias("n"))
    total, words = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total:
        return Index(cut(items.sparkSession.createDataFrame([], "number int, size long, shard binary"), "shards"), [])
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / (words / total)))
    weighted = rows.join(df, "term").select("no", "n", "term", impact.alias("impact"))
    empty = lambda kind: F.lit(None).cast(kind)
    every = (
        weighted.select("n", "no", F.lit(1).alias("kind"), empty("long").alias("id"), empty("string").alias("text"), "term", "impact")
        .unionByName(items.join(sizes, "no").select("n", "no", F.lit(0).alias("kind"), "id", "text", empty("long").alias("term"), empty("double").alias("impact")))
    )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items come by length, each with its text first, then its terms."""
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 16, []  # [id, text, terms, impacts, words]

        def out():
            nonlocal number
            blob = pickle.dumps(make_shard([x[0] for x in held], [x[1] for x in held], [(np.concatenate(x[2]), np.concatenate(x[3])) for x in held]), 5)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], ["number", "size", "shard"])

        for batch in batches:
            kind = batch.column(2).to_numpy()
            if not len(kind):
                continue
            edges = np.append(np.flatnonzero(kind == 0), len(kind))
            for a, b in zip(np.concatenate([[0], edges[:-1]]), edges, strict=True):
                if a == b and a < len(kind) and kind[a] == 0:
                    continue
                if kind[a] == 0:
                    if len(held) == SHARD or sum(x[4] for x in held) >= SHARD_WORDS:
                        yield out()
                        held = []
                    held.append([batch.column(3)[int(a)].as_py(), batch.column(4)[int(a)].as_py(), [], [], batch.column(0)[int(a)].as_py()])
                    a += 1
                if a < b:
                    held[-1][2].append(batch.column(5).slice(a, b - a).to_numpy().view(np.uint64))
                    held[-1][3].append(batch.column(6).slice(a, b - a).to_numpy())
        if held:
            yield out()

    parts = max(1, math.ceil(words / SHARD_WORDS), math.ceil(total / SHARD))
    dealt = every.repartitionByRange(parts, "n", "no").sortWithinPartitions("n", "no", "kind", "term")
    table = cut(dealt.mapInArrow(shards, "number int, size long, shard binary"), "shards")
    release(rows, items)
    passes, room = [], 0
    for number, size in table.select("number", "size").orderBy("number").collect():
        if size > room:
            passes, room = [*passes, []], PASS_BYTES
        passes[-1].append(number)
        room -= size
    return Index(table, passes)


def find_leaks(docs: DataFrame, found: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, score, overlap, question_overlap, answer_overlap): one row for each document and item that leaks into it."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    out = None
    for numbers in found.passes:
        sent = docs.sparkSession.sparkContext.broadcast(found.shards(numbers))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in tk.slices(batches, text_col):
                got = leaks(sent.value, *tk.string_buffers(part.column(1)))
                cols = list(zip(*got, strict=True)) or [[]] * 6
                rows = part.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], [id_col, "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
                )

        one = docs.select(id_col, text_col).mapInArrow(run, schema)
        if len(found.passes) > 1:
            one = cut(one, "leaks")
            sent.destroy()
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, found: Index, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks, unchanged and in place: no shuffle."""
    for numbers in found.passes:
        sent = docs.sparkSession.sparkContext.broadcast(found.shards(numbers))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in tk.slices(batches, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, *_ in leaks(sent.value, *tk.string_buffers(part.column(part.schema.get_field_index(text_col))))]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if len(found.passes) > 1:
            docs = cut(docs, "clean")
            sent.destroy()
    return docs
