"""Language-model scores by a hidden Markov model over words.

Tokens are words (textkit) and one end a document. Counts of all training tokens are summed over the cluster. The model
has STATES latent states. A state emits one of the VOCABULARY commonest words, the end, or one of CLASSES classes of rare
words (by a word's last bytes); within a class a word has the share (c + 0.1) of its count c, and all unseen words of a
class share one symbol of count 0. So the probabilities of all known words, the unseen symbols and the end sum to 1.

Training: symbols of all training documents are written once, in SLICES by a hash of the id. One sweep of stepwise
Baum-Welch takes the slices in turn (expected counts of a slice are mixed into those so far), then ROUNDS rounds of
Baum-Welch read them all; expected counts are added up across partitions. So what is gathered grows with the input.
Documents are read in segments of SEGMENT tokens with CONTEXT tokens on either side: every token and every transition is
counted once, with posteriors that know their surroundings. Scoring: the scaled forward recursion over each whole
document, exactly.

Counts of the KNOWN_MOST commonest words go to all executors (a list of bounded length); every other token is joined with
the count table by its hash. A word is known by a 56-bit hash and its class; two words meet with a chance near n^2 / 2^57.
Null texts are empty: one end. Texts of any length are read whole. Repeated rows are scored each. Ties of counts are
ordered by hash. Without training documents every token is the one unseen symbol, and both scores are 0. Empty tables
give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import cut, release

STATES, VOCABULARY, CLASSES = 16, 16384, 256
KNOWN_MOST = 1 << 20
SEGMENT, CONTEXT, SLICES, ROUNDS = 128, 16, 8, 2
SYMBOLS = VOCABULARY + CLASSES + 1
END = SYMBOLS - 1
ROWS = 256
PRIOR = 50.0
_U = np.uint64
_LOW = _U(CLASSES - 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word keys (56 bits of hash, then the class) and offsets by row, ends left out."""
    h, rows, s, e = tk.words(raw, offsets, spans=True)
    tail = np.zeros(len(h), np.uint64)
    for k in (1, 2, 3):
        tail = tail * _U(257) + np.where(e - k >= s, _FOLD[raw[np.maximum(e - k, 0)]], 0).astype(np.uint64)
    return (h & ~_LOW) | (tk.mix(tail) & _LOW), rows


def _count(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out():
            x = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
            return pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)), pa.array(np.diff(np.append(first, len(x))))], ["key", "n"])

        for part in tk.slices(batches, "text"):
            held.append(tokens(*tk.string_buffers(part.column(0)))[0])
            size += len(held[-1])
            if size > 1 << 23:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """What executors need of the corpus counts."""

    keys: np.ndarray  # the commonest words
    logs: np.ndarray  # log10(c + 0.1)
    symbol: np.ndarray  # their symbols
    total: int
    distinct: int
    class_mass: np.ndarray  # by class: sum of c + 0.1 over rare words and the unseen one
    unigram: np.ndarray  # probabilities of symbols


def gather(counts: DataFrame, ends: int) -> Counts:
    """Totals, classes and the commonest words of a count table (key, n); ``ends``: training documents."""
    bucket = F.floor(F.log2("n") * 16)
    sizes = {r[0]: r[1] for r in counts.groupBy(bucket.alias("b")).count().collect()}
    kept, least = 0, None
    for b in sorted(sizes, reverse=True):
        if kept + sizes[b] > KNOWN_MOST:
            break
        kept, least = kept + sizes[b], b
    top = counts.where(bucket >= least).toArrow() if least is not None else None
    keys = top["key"].to_numpy().view(np.uint64) if top is not None else np.zeros(0, np.uint64)
    n = top["n"].to_numpy() if top is not None else np.zeros(0, np.int64)
    order = np.lexsort((keys, -n))
    keys, n = keys[order], n[order]
    words = min(VOCABULARY, len(keys))
    symbol = np.concatenate([np.arange(words), VOCABULARY + (keys[words:] & _LOW).astype(np.int64)]).astype(np.int32)
    by_class = counts.groupBy(F.col("key").bitwiseAND(CLASSES - 1).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    mass, rare = np.full(CLASSES, 0.1), np.zeros(CLASSES)
    total, distinct = ends, int(ends > 0)
    for c, s, v in by_class:
        mass[c] += s + 0.1 * v
        rare[c] += s
        total += s
        distinct += v
    c = (keys[:words] & _LOW).astype(np.int64)
    np.subtract.at(mass, c, n[:words] + 0.1)
    np.subtract.at(rare, c, n[:words])
    unigram = np.concatenate([n[:words], np.zeros(VOCABULARY - words), rare + 0.5, [ends + 0.5]])
    unigram[words:VOCABULARY] = 0
    return Counts(keys, np.log10(n + 0.1), symbol, int(total), int(distinct), np.maximum(mass, 0.1), unigram / unigram.sum())


@dataclass
class Hmm:
    start: np.ndarray  # of documents
    mid: np.ndarray  # of later segments
    move: np.ndarray
    emit: np.ndarray  # (symbols, states)


def first_model(unigram: np.ndarray, seed: int = 5) -> Hmm:
    rng = np.random.Generator(np.random.PCG64(seed))
    emit = unigram[:, None] * rng.gamma(2.0, 0.5, (SYMBOLS, STATES)) + 1e-12
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    even = np.full(STATES, 1 / STATES)
    return Hmm(even, even, move, emit / emit.sum(axis=0))


def _grid(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as (T, B), longest first; how many are active at each step; their order."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    grid = np.zeros((int(size.max()), len(seqs)), np.int32)
    for b, i in enumerate(order):
        grid[: size[i], b] = seqs[i]
    return grid, np.searchsorted(-size[order], -np.arange(len(grid)), "left"), order


def expected(model: Hmm, seqs: list[np.ndarray], firsts: np.ndarray, out: dict, spans: np.ndarray | None = None) -> None:
    """Add the expected counts of sequences (firsts: begin a document) to ``out``; of each only the tokens in its span
    (from, to) and the transitions into them."""
    grid, active, order = _grid(seqs)
    spans = (np.array([(0, len(s)) for s in seqs]) if spans is None else spans)[order]
    steps, n = grid.shape
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    alpha, scale = np.zeros((steps, n, STATES), np.float32), np.ones((steps, n), np.float32)
    for t in range(steps):
        m = active[t]
        a = np.where(firsts[order][:, None], model.start, model.mid).astype(np.float32) if t == 0 else alpha[t - 1, :m] @ move
        a = a * emit[grid[t, :m]]
        scale[t, :m] = np.maximum(a.sum(axis=1), 1e-30)
        alpha[t, :m] = a / scale[t, :m, None]
    beta = np.ones((n, STATES), np.float32)
    gammas, symbols = [], []
    for t in range(steps - 1, -1, -1):
        m = active[t]
        inside = ((spans[:m, 0] <= t) & (t < spans[:m, 1])).astype(np.float32)[:, None]
        gamma = alpha[t, :m] * beta[:m] * inside
        gammas.append(gamma)
        symbols.append(grid[t, :m])
        if t:
            b = emit[grid[t, :m]] * beta[:m] / scale[t, :m, None]
            out["move"] += (alpha[t - 1, :m].T @ (b * inside)) * move
            beta[:m] = b @ move.T
        else:
            out["start"] += gamma[firsts[order][:m]].sum(axis=0)
    gamma, symbol = np.concatenate(gammas), np.concatenate(symbols)
    for k in range(STATES):
        out["emit"][:, k] += np.bincount(symbol, gamma[:, k], minlength=SYMBOLS)


def empty_counts() -> dict:
    return {"move": np.zeros((STATES, STATES)), "start": np.zeros(STATES), "emit": np.zeros((SYMBOLS, STATES))}


def maximise(out: dict, unigram: np.ndarray) -> Hmm:
    start, move, emit = out["start"] + 1 / STATES, out["move"] + 1 / STATES, out["emit"] + PRIOR * unigram[:, None]
    mid = out["emit"].sum(axis=0) + 1 / STATES
    return Hmm(start / start.sum(), mid / mid.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Reader:
    """Symbols of texts."""

    def __init__(self, counts: Counts):
        self.counts, self.table = counts, tk.HashTable(counts.keys)

    def read(self, raw: np.ndarray, offsets: np.ndarray):
        """Word keys, positions in the list of commonest words (-1: not there), symbols, offsets by row."""
        keys, rows = tokens(raw, offsets)
        at = self.table.find(keys)
        symbol = np.where(at >= 0, self.counts.symbol[at] if len(self.counts.symbol) else 0, VOCABULARY + (keys & _LOW).astype(np.int32)).astype(np.int32)
        return keys, at, symbol, rows


def segments(docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[bool], list[tuple[int, int]]]:
    """Segments of documents (symbols, ends included) with their surroundings, whether they begin one, and their own spans."""
    seqs, firsts, spans = [], [], []
    for s in docs:
        for k in range(0, len(s), SEGMENT):
            a, end = max(k - CONTEXT, 0), min(k + SEGMENT, len(s))
            seqs.append(s[a : end + CONTEXT])
            firsts.append(a == 0)
            spans.append((k - a, end - a))
    return seqs, firsts, spans


def _collect(model: Hmm, docs: list[np.ndarray], out: dict, batch: int = 1024) -> None:
    seqs, firsts, spans = segments(docs)
    order = np.argsort([len(s) for s in seqs], kind="stable")
    for k in range(0, len(order), batch):
        i = order[k : k + batch]
        expected(model, [seqs[j] for j in i], np.array([firsts[j] for j in i]), out, np.array([spans[j] for j in i]))


def _symbols(docs: DataFrame, counts_sent) -> DataFrame:
    """(slice, symbols) of documents (slice, text), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(counts_sent.value)
        for part in tk.slices(batches, "text"):
            _, _, symbol, rows = reader.read(*tk.string_buffers(part.column(1)))
            out = [np.append(symbol[a:b], END).astype(np.uint16).tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["slice", "symbols"])

    return docs.select("slice", "text").mapInArrow(run, "slice int, symbols binary")


def _round(symbols: DataFrame, model: Hmm) -> dict | None:
    """Expected counts over a table of symbols: added up in partitions, then across them in blocks of symbols."""
    sent = symbols.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size, seen = empty_counts(), [], 0, False
        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_buffer(), np.uint16).astype(np.int32))
                size += len(held[-1])
                if size > 1 << 19:
                    _collect(sent.value, held, out)
                    held, size, seen = [], 0, True
        if held:
            _collect(sent.value, held, out)
        if held or seen:
            whole = np.concatenate([out["emit"], out["move"], out["start"][None]]).astype(np.float32)
            blocks = range(0, len(whole), ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([k // ROWS for k in blocks], pa.int32()), pa.array([whole[k : k + ROWS].tobytes() for k in blocks], pa.binary())], ["block", "counts"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), np.float32).astype(np.float64) for b in table.column("counts"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    got = symbols.select("symbols").mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    sent.destroy()
    if not got:
        return None
    whole = np.concatenate([np.frombuffer(r[1]) for r in sorted(got, key=lambda r: r[0])]).reshape(-1, STATES)
    return {"emit": whole[:SYMBOLS], "move": whole[SYMBOLS : SYMBOLS + STATES], "start": whole[-1]}


def train(docs: DataFrame, counts: Counts, counts_sent) -> Hmm:
    """One sweep over the slices, then rounds over all of ``docs`` (doc_id, text)."""
    sliced = docs.select(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(SLICES)).cast("int").alias("slice"), "text")
    symbols = cut(_symbols(sliced, counts_sent), "symbols", ("slice",))
    model, so_far, steps = first_model(counts.unigram), None, 0
    for k in range(SLICES):
        found = _round(symbols.where(F.col("slice") == k), model)
        if found:
            steps += 1
            pace = steps**-0.7 if so_far else 1.0
            so_far = {c: (1 - pace) * so_far[c] + pace * SLICES * found[c] if so_far else SLICES * found[c] for c in found}
            model = maximise(so_far, counts.unigram)
    for _ in range(ROUNDS):
        model = maximise(_round(symbols, model), counts.unigram)
    release(symbols)
    return model


def forward(model: Hmm, symbol: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log10 likelihoods of whole documents (symbols by row, an end added to each) by the scaled forward recursion."""
    size = np.diff(rows)
    order = np.argsort(-size, kind="stable")
    begin, long = rows[:-1][order], size[order]
    active = np.searchsorted(-long, -np.arange(int(long[0]) + 2 if len(long) else 0), "right")
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    total = np.zeros(len(size))
    a = np.tile(model.start.astype(np.float32), (len(size), 1))
    for t in range(int(long[0]) + 1 if len(long) else 0):
        m = active[t]
        more = active[t + 1]  # those after ``more`` end here
        if t:
            a = a[:m] @ move
        now = np.full(m, END, np.int32)
        now[:more] = symbol[begin[:more] + t]
        a = a * emit[now]
        c = np.maximum(a.sum(axis=1), 1e-37)
        a /= c[:, None]
        total[:m] += np.log10(c)
    out = np.empty(len(size))
    out[order] = total
    return out


def _scored(docs: DataFrame, counts_sent, model_sent) -> DataFrame:
    """Rows of documents (kind 0) and of their tokens that are not in the list of commonest words (kind 1: rid, key)."""
    fields = [("kind", pa.int32()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("words", pa.int64()), ("rare", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("hmm", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, model = counts_sent.value, model_sent.value
        reader, rid = Reader(counts), TaskContext.get().partitionId() << 40
        log_mass = np.log10(counts.class_mass)
        for part in tk.slices(batches, "text", 8 << 20):
            keys, at, symbol, rows = reader.read(*tk.string_buffers(part.column(1)))
            n, ids = np.diff(rows), np.arange(rid, rid + part.num_rows)
            rid += part.num_rows
            here = at >= 0
            logs = np.where(here, counts.logs[at] if len(counts.logs) else 0.0, 0.0)
            rare = symbol >= VOCABULARY
            inside = np.where(rare, logs - log_mass[np.where(rare, symbol - VOCABULARY, 0)], 0.0)
            hmm = forward(model, symbol, rows) + tk.sum_by_row(inside, rows) if model else np.zeros(len(n))
            cols = {
                "kind": np.zeros(len(n), np.int32), "rid": ids, "doc_id": part.column(0), "words": n, "rare": tk.sum_by_row(rare.astype(np.int64), rows),
                "known": tk.sum_by_row(here.astype(np.int64), rows), "base": tk.sum_by_row(logs, rows), "hmm": hmm,
            }
            yield pa.RecordBatch.from_arrays([pa.array(cols[f], t) if f in cols and not isinstance(cols[f], pa.Array) else cols.get(f, pa.nulls(len(n), t)) for f, t in fields], [f for f, _ in fields])
            far = np.flatnonzero(~here)
            if len(far) and model:
                tail = {"kind": np.ones(len(far), np.int32), "rid": ids[tk.row_index(rows)[far]], "key": keys[far].view(np.int64)}
                yield pa.RecordBatch.from_arrays([pa.array(tail[f], t) if f in tail else pa.nulls(len(far), t) for f, t in fields], [f for f, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind int, rid long, doc_id long, key long, words long, rare long, known long, base double, hmm double")


def score_documents(docs: DataFrame, teach: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row; ``teach`` picks training documents."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    learn = docs.where(teach)
    ends = learn.count()
    counts_table = cut(_count(learn), "word-counts")
    counts = gather(counts_table, ends)
    counts_sent = spark.sparkContext.broadcast(counts)
    model = train(learn, counts, counts_sent) if ends else None
    rows = cut(_scored(docs, counts_sent, spark.sparkContext.broadcast(model)), "scored")
    tail = (
        rows.where("kind = 1").select("rid", "key").join(counts_table, "key", "left")
        .groupBy("rid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail"), F.count("n").alias("tail_known"))
    )
    end = float(np.log10(ends + 0.1))
    whole = float(np.log10(counts.total + 0.1 * (counts.distinct + 1)))
    mine = F.col("words") + 1
    extra = F.coalesce("tail", F.lit(0.0))
    return (
        rows.where("kind = 0").join(tail, "rid", "left")
        .select(
            "doc_id", mine.alias("n_tokens"), (F.col("known") + F.coalesce("tail_known", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
            (F.col("base") + extra + end - mine * whole if model else F.lit(0.0)).alias("base_score"), (F.col("hmm") + extra).alias("score"),
        )
    )
