from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    h, rows, s, e = tk.words(*tk.string_buffers(pa.array(texts, pa.string())), spans=True)
    raw = "".join(t or "" for t in texts).encode()
    got = [[raw[a:b].decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(rows[:-1], rows[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    assert [int(x) for x in h] == [tk.word_hash(lower(w)) for t in texts for w in WORD.findall(t or "")]


def test_words_across_chunks(monkeypatch):
    texts = ["abc def ghi " * 50, "x" * 500 + " y", ""]
    want = tk.words(*tk.string_buffers(pa.array(texts)))
    monkeypatch.setattr(tk, "CHUNK", 64)
    got = tk.words(*tk.string_buffers(pa.array(texts)))
    assert all((a == b).all() for a, b in zip(want, got))


def test_ngrams_and_short_rows():
    h, rows = tk.words(*tk.string_buffers(pa.array(["a b c d e f", "a b", "", "a b c d e"])))
    grams, at = tk.ngrams(h, rows, 5)
    assert np.diff(at).tolist() == [2, 1, 0, 1]
    assert grams[0] == grams[3] and len(set(grams.tolist())) == 3


def test_hash_table():
    keys = tk.mix(np.arange(1, 5000, dtype=np.uint64))
    table = tk.HashTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(tk.mix(np.arange(10**6, 10**6 + 100, dtype=np.uint64))) == -1).all()
    assert len(tk.HashTable(keys[:0]).find(keys[:3])) == 3


def test_slices_bound_bytes_and_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 10, None, "y" * 100, "", "z", "u" * 30])], ["id", "text"])
    parts = list(tk.slices(iter([batch]), "text", 32))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6))
    assert len(parts) > 2
