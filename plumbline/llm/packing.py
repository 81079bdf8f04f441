"""Lexical retrieval packing of documents into token sequences of one length.

Documents are taken in shards (up to SHARD_DOCS documents or SHARD_TOKENS tokens of a partition, in order), so memory is
bounded and nothing is shuffled. Each shard has a BM25 inverted index over hashed words. A seed document opens a window;
its unused neighbours by BM25, asked with all its terms, fill the window best first, as many as it takes, and are cut
where it is full. The document that was cut seeds the next window. So every window is full but the last of a partition,
which is split into windows whose lengths are powers of two and so need no padding. Documents of different shards are
never neighbours.

Scores are exact: terms in more than a DENSE-th of a shard are scored by matrix products, all others by their postings.
Impacts are whole multiples of 1 / UNIT, so sums do not depend on their order and equal documents tie everywhere.

Token ids are those of the given tokenizer file for the text as ordinary text, then id 0. Text of common letters goes
through an equal, faster encoder over the same vocabulary; any other text through the file itself. Null texts are empty
and give the one id 0. Empty input gives no rows, extra columns are ignored, repeated rows are packed each. Sequence ids
come from the partition number and are the same when a lost task is run again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk

SHARD_DOCS = 2048
SHARD_TOKENS = 1 << 22
TERM_BITS = 20
DENSE = 16
DENSE_COLUMNS = 512
UNIT = 1 << 20
PAGE = 8
K1, B = 1.2, 0.75
_COMMON = re.compile(r"[\t\n\r\x20-\x7e¡-ÿ–—‘’“”€]*")
_encoders: dict[tuple, object] = {}


class Encoder:
    """Token ids of texts, by a tokenizer file and, for common text, the same vocabulary as ranks."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.path, self._slow, self.fast = tokenizer_path, None, None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        """The tokenizer file itself, read when a text first needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True
        return self._slow

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _COMMON.fullmatch(text):
            got = self.fast.encode_ordinary(text)
        else:
            got = self.slow.encode(text, add_special_tokens=False).ids
        out = np.zeros(len(got) + 1, np.uint32)
        out[:-1] = got
        return out


def encoder(*files) -> Encoder:
    if files not in _encoders:
        _encoders[files] = Encoder(*files)
    return _encoders[files]


class Index:
    """A BM25 inverted index over the hashed words of a shard."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        h, rows = tk.words(raw, offsets)
        n = len(rows) - 1
        self.n = n
        doc_bits = max(1, (n - 1).bit_length())
        key = np.sort(((h >> np.uint64(64 - TERM_BITS)) << np.uint64(doc_bits) | tk.row_index(rows).astype(np.uint64)).astype(np.uint32 if TERM_BITS + doc_bits <= 32 else np.uint64))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        tf = np.diff(np.append(first, len(key))).astype(np.float32)
        key = key[first]
        self.doc = (key & ((1 << doc_bits) - 1)).astype(np.int32)
        term = key >> doc_bits
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, int)
        df = np.diff(np.append(start, len(term)))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
        length = np.diff(rows).astype(np.float32)
        norm = K1 * (1 - B + B * length / max(float(length.mean()), 1e-9))
        self.impact = np.rint(np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc]) * UNIT).astype(np.float64)
        self.start, self.df = start, df
        common = df > max(n // DENSE, 1)
        at = np.flatnonzero(np.repeat((df > 1) & ~common, df))
        posting = np.repeat(np.arange(len(df)), df)[at]
        order = np.argsort(self.doc[at], kind="stable")
        self.own = posting[order].astype(np.int32)  # a document's terms that others share, but for common ones
        self.own_at = np.concatenate([[0], np.cumsum(np.bincount(self.doc[at], minlength=n))])
        self.common = self._common(np.flatnonzero(common))

    def _common(self, terms: np.ndarray) -> np.ndarray:
        """Scores (query, document) from the given terms alone."""
        out = np.zeros((self.n, self.n))
        for k in range(0, len(terms), DENSE_COLUMNS):
            some = terms[k : k + DENSE_COLUMNS]
            at, column = self._postings(some), np.repeat(np.arange(len(some)), self.df[some])
            impact = np.zeros((self.n, len(some)))
            impact[self.doc[at], column] = self.impact[at]
            has = np.zeros((self.n, len(some)))
            has[self.doc[at], column] = 1
            out += has @ impact.T
        return out

    def _postings(self, terms: np.ndarray) -> np.ndarray:
        """Where the postings of terms are, term by term."""
        size = self.df[terms]
        return np.repeat(self.start[terms] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 scores, times UNIT, of all documents for one as query."""
        at = self._postings(self.own[self.own_at[doc] : self.own_at[doc + 1]])
        return self.common[doc] + np.bincount(self.doc[at], self.impact[at], minlength=self.n)

    def ranked(self, doc: int, free: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with one as query, best first; ties to the first in order."""
        score = self.scores(doc) * free
        left, page = np.flatnonzero(score > 0), PAGE
        while len(left):
            if len(left) > page:
                least = -np.partition(-score[left], page - 1)[page - 1]
                now, left = left[score[left] >= least], left[score[left] < least]
            else:
                now, left = left, left[:0]
            yield from now[np.argsort(-score[now], kind="stable")].tolist()
            page *= 8

    def neighbours(self, doc: int, free: np.ndarray) -> list[int]:
        return list(self.ranked(doc, free))


class Packer:
    """Fills windows from shards; what is open goes on from shard to shard."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.used, self.open, self.rows = 0, [], []

    def put(self, doc_id, ids: np.ndarray) -> bool:
        """Add a document, cut at windows' ends; whether it was cut or ended a window."""
        at, closed = 0, False
        while at < len(ids):
            take = min(self.window - self.used, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            self.used += take
            at += take
            if self.used == self.window:
                self._close(self.open)
                self.open, self.used, closed = [], 0, True
        return closed

    def _close(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Split what is open into windows whose lengths are powers of two."""
        left, pieces = self.used, list(self.open)
        while left:
            room, now = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                take = min(room, len(ids))
                now.append((doc_id, start, ids[:take], total))
                if take < len(ids):
                    pieces.insert(0, (doc_id, start + take, ids[take:], total))
                room -= take
            self._close(now)
        self.open, self.used = [], 0


def pack_shard(packer: Packer, doc_ids: list, tokens: list[np.ndarray], index: Index) -> None:
    """Place every document of a shard: a seed, then its unused neighbours until its window is full, and so on."""
    free = np.ones(len(doc_ids))
    seed, after = 0, None
    while True:
        if after is None:
            while seed < len(doc_ids) and not free[seed]:
                seed += 1
            if seed == len(doc_ids):
                return
            now = seed
            free[now] = 0
            packer.put(doc_ids[now], tokens[now])
        else:
            now, after = after, None
        if not packer.used:
            continue
        for k in index.ranked(now, free):
            free[k] = 0
            if packer.put(doc_ids[k], tokens[k]):
                after = k if packer.used else None
                break


def _shards(batches: Iterator[pa.RecordBatch], encode: Encoder):
    ids, texts, tokens, held = [], [], [], 0
    for part in tk.slices(batches, "text"):
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            tokens.append(encode.ids(texts[-1]))
            held += len(tokens[-1])
            if len(ids) == SHARD_DOCS or held >= SHARD_TOKENS:
                yield ids, texts, tokens
                ids, texts, tokens, held = [], [], [], 0
    if ids:
        yield ids, texts, tokens


def pack(docs: DataFrame, files: tuple, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row a piece; ``files``: arguments of Encoder."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(window, TaskContext.get().partitionId() << 40)
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def out(id_type):
            cols = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        id_type = None

        def typed():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                yield batch

        for ids, texts, tokens in _shards(typed(), encoder(*files)):
            pack_shard(packer, ids, tokens, Index(*tk.string_buffers(pa.array(texts, pa.large_string()))))
            yield out(id_type)
        packer.finish()
        if packer.rows:
            yield out(id_type)

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
