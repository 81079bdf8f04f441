"""Vectorised text handling over Arrow string columns: whole texts, no row-at-a-time work.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; being ASCII rules, they hold on
UTF-8 bytes as on code points. A word is known by a 64-bit hash (per-byte random values under a polynomial, then
mixed); two different words meet in one hash with a chance near n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_PINV = _U(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = np.ones(256, bool)
_GAP[128:] = _GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for key, base in (("up", _P), ("down", _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``max_bytes`` of text (one row at least), so that memory stays bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = string_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def _segments(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Chunks that end at white space (or at the end), so that no word is cut."""
    at, n = 0, len(raw)
    while at < n:
        to = min(at + CHUNK, n)
        while to < n:
            gap = np.flatnonzero(_SPACE[raw[to : to + 65536]])
            if len(gap):
                to += int(gap[0]) + 1
                break
            to = min(to + 65536, n)
        yield at, to
        at = to


def words(raw: np.ndarray, offsets: np.ndarray, spans: bool = False, letters: bool = False):
    """Hashes of all words in order, and n+1 offsets into them by row; with ``spans`` also their byte starts and ends.

    With ``letters`` words are runs of ASCII letters and digits and of any other characters beyond ASCII: punctuation parts them.
    """
    gap = _GAP if letters else _SPACE
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    hashes, starts, ends = [], [], []
    for at, to in _segments(raw):
        piece = raw[at:to]
        ink = ~gap[piece]
        edge = first[at : to + 1]
        before = np.empty(len(piece), bool)
        before[0] = False
        before[1:] = ink[:-1]
        s = np.flatnonzero(ink & (~before | edge[:-1]))
        after = np.empty(len(piece), bool)
        after[-1] = False
        after[:-1] = ink[1:]
        e = np.flatnonzero(ink & (~after | edge[1:])) + 1
        up, down = _power(len(piece) + 1)
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE[piece] * up[: len(piece)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    rows = np.searchsorted(s, offsets).astype(np.int64)
    if not spans:
        return h, rows
    return h, rows, s, (np.concatenate(ends) if ends else np.zeros(0, np.int64))


def word_hash(word: str) -> int:
    """The hash of one word (no white space in it)."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)]))[0][0])


def row_index(offsets: np.ndarray) -> np.ndarray:
    """The row of each element under n+1 offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ngrams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row; a row of 1 to n-1 words gives its whole sequence as one."""
    count = np.diff(offsets)
    out = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    rows = np.zeros(len(out) + 1, np.int64)
    np.cumsum(out, out=rows[1:])
    start = np.arange(rows[-1]) - np.repeat(rows[:-1] - offsets[:-1], out)
    length = np.repeat(np.minimum(count, n), out)
    got = np.zeros(len(start), np.uint64)
    for k in range(n):
        within = length > k
        if within.all():
            got = mix(got + h[start + k]) * _P
        else:
            i = np.flatnonzero(within)
            got[i] = mix(got[i] + h[start[i] + k]) * _P
    return mix(got + length.astype(np.uint64)), rows


def sum_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums under n+1 offsets, empty rows included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class HashTable:
    """Distinct 64-bit hashes to their positions; lookups of whole arrays by linear probing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        size = 1 << self.bits
        self.keys, self.at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = (mix(keys) >> _U(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            won = self.at[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (size - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes, -1 where unknown."""
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), (mix(h) >> _U(64 - self.bits)).astype(np.int64)
        while len(left):
            at = self.at[slot]
            same = (self.keys[slot] == h[left]) & (at >= 0)
            out[left[same]] = at[same]
            on = ~same & (at >= 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.at) - 1)
        return out
