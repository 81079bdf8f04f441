from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, decontaminate, embedding, jaccard, langid, lm, packing, pii, sharding, toxicity
from plumbline.llm.queries import tokenizer_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def letters(t):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1 language identification


def _speech(rng, lang, n):
    parts = {"en": ["the", "ing", "th", "ed", "wh"], "de": ["sch", "ung", "keit", "der", "ü"], "fr": ["eau", "é", "tion", "le", "oui"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_langid_learns_and_reads_whole_texts(docs_frame, odd_texts):
    rng = random.Random(3)
    rows = [(100 + i, _speech(rng, lang, rng.randint(3, 80)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = docs_frame(rows + [(i, t, None) for i, t in odd_texts] + [(50, "12 34 !!"), (51, "x" * 200 + " " + _speech(rng, "fr", 900))])
    teach = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    got = langid.identify(docs, langid.fit(docs, teach)).collect()
    pred = {r["doc_id"]: r for r in got}
    assert len(got) == docs.count()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(pred[i]["lang_pred"] == lang for i, _, lang in held) >= 0.95 * len(held)
    assert pred[51]["lang_pred"] == "fr"
    assert all(pred[i]["lang_pred"] == "und" and pred[i]["score"] == 0 for i in (1, 2, 3, 50))
    assert all(0 <= r["score"] <= 1 for r in got)


def test_langid_gradients_are_right():
    rng = np.random.default_rng(0)
    layer = langid.Layer(rng.normal(0, 0.5, (256, 12)), rng.normal(0, 0.5, (4, 12)))
    x, mask = rng.integers(0, 5, (3, 6)).astype(np.uint8), np.ones((3, 6))
    mask[1, 4:] = 0
    weight = rng.normal(size=(6, 3, 4))

    def loss():
        return sum((weight[t] * after).sum() for t, *_, after in langid._run(layer, x, mask, False))

    de, du = langid._back(layer, x, langid._run(layer, x, mask, False), weight)
    for array, grad, at in ((layer.e, de, (int(x[0, 0]), 2)), (layer.e, de, (int(x[2, 3]), 9)), (layer.u, du, (1, 5)), (layer.u, du, (3, 11))):
        kept = array[at]
        array[at] = kept + 1e-5
        up = loss()
        array[at] = kept - 1e-5
        down = loss()
        array[at] = kept
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-2 * max(1, abs(grad[at]))


def test_langid_gradients_of_every_parameter_are_right():
    rng = np.random.default_rng(4)
    size, langs = 3, 4
    params = [rng.normal(0, 0.5, (256, 3 * size)), rng.normal(0, 0.5, (size, 3 * size)), rng.normal(0, 0.5, (256, 3 * size)), rng.normal(0, 0.5, (size, 3 * size)), rng.normal(0, 0.5, (2 * size, langs)), rng.normal(size=langs)]
    x, mask = rng.integers(0, 4, (3, 5)).astype(np.uint8), np.ones((3, 5))
    mask[2, 3:] = 0
    y, weight = np.array([0, 3, 1]), np.array([1.0, 0.5, 2.0])

    def states():
        h = np.zeros((5, 3, 2 * size))
        for k in (0, 1):
            for t, *_, after in langid._run(langid.Layer(params[2 * k], params[2 * k + 1]), x, mask, bool(k)):
                h[t, :, k * size : (k + 1) * size] = after
        return h

    def loss():
        z = states() @ params[4] + params[5]
        p = z - np.log(np.exp(z).sum(axis=2, keepdims=True))
        return -(p[:, np.arange(3), y] * mask.T * weight).sum() / mask.sum()

    grads = langid.gradients(params, x, mask, y, weight)
    for array, grad in zip(params, grads, strict=True):
        for at in [np.unravel_index(k, array.shape) for k in rng.permutation(array.size)[:12]] + [tuple(v[0] for v in np.nonzero(grad))]:
            kept = array[at]
            array[at] = kept + 1e-5
            up = loss()
            array[at] = kept - 1e-5
            down = loss()
            array[at] = kept
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6 + 1e-3 * abs(grad[at])


def test_langid_reader_equals_the_training_pass():
    rng = np.random.default_rng(8)
    size = 5
    layers = [langid.Layer(rng.normal(0, 0.4, (256, 3 * size)).astype(np.float32), rng.normal(0, 0.4, (size, 3 * size)).astype(np.float32)) for _ in range(2)]
    model = langid.Model(layers, rng.normal(size=(2 * size, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32), ["a", "b", "c"])
    texts = ["short", "x" * 64, "A longer text, with CAPITALS and ünïcödé " * 5, "y" * 129, ""]
    got = langid.Reader(model).documents(*langid.tk.string_buffers(langid.pa.array(texts)))
    for text, pooled in zip(texts, got, strict=True):
        raw, total = langid._FOLD[np.frombuffer(text.encode(), np.uint8)], np.zeros(3)
        for k in range(0, len(raw), langid.WINDOW):
            x = raw[None, k : k + langid.WINDOW]
            h = np.zeros((x.shape[1], 2 * size))
            for j in (0, 1):
                for t, *_, after in langid._run(layers[j], x, np.ones(x.shape, np.float32), bool(j)):
                    h[t, j * size : (j + 1) * size] = after[0]
            z = np.exp(h @ model.w + model.b)
            total += (z / z.sum(axis=1, keepdims=True)).sum(axis=0)
        assert np.abs(pooled - total / max(len(raw), 1)).max() < 1e-4


def test_langid_learns_every_language(docs_frame, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda windows, labels: sorted(set(labels)))
    docs = docs_frame([(i, chr(97 + i % 70 % 26) * (2 + i % 70 // 26) + f" {chr(97 + i % 70 // 26)}", f"l{i % 70:02d}") for i in range(210)])
    assert len(langid.fit(docs)) == 70 and len(langid.fit(docs, most_docs=140)) > 64


def test_langid_without_labels(docs_frame):
    docs = docs_frame([(1, "abc", None), (2, None, None)])
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).collect()} == {"und"}


# 2 packing


def test_packing_is_an_exact_cover(docs_frame, odd_texts, sentences):
    rows = odd_texts + [(100 + i, sentences(i, 5 + 37 * i % 900)) for i in range(60)] + [(500, "a <|endoftext|> b")]
    docs = docs_frame(rows)
    encode = packing.encoder(*tokenizer_files())
    pieces = packing.pack(docs, tokenizer_files()).collect()
    want = Counter()
    for i, t in rows:
        ids = np.append(encode.slow.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4")
        want[i] += len(ids)
        for p in (p for p in pieces if p["doc_id"] == i):
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
    got, seqs = Counter(), {}
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert got == want
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        total = sum(n for _, n in s)
        assert total <= 1024 and (total == 1024 or total & (total - 1) == 0)


def test_fast_encoder_equals_the_tokenizer_file():
    encode = packing.encoder(*tokenizer_files())
    rng = random.Random(1)
    letters = [chr(c) for c in (*range(32, 127), 9, 10, 13, *range(0xA1, 0x100))] + ["  ", "the", "'s", "été"]
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        assert encode.ids(text).tolist()[:-1] == encode.slow.encode(text, add_special_tokens=False).ids


def test_fast_encoder_equals_the_tokenizer_file_on_every_token():
    """All tokens of the vocabulary that common text can hold, alone, after a space, doubled, and before a letter or digit."""
    import base64

    encode = packing.encoder(*tokenizer_files())
    texts = []
    for line in open(tokenizer_files()[1], "rb"):
        try:
            token = base64.b64decode(line.split()[0]).decode()
        except UnicodeDecodeError:
            continue
        if packing._COMMON.fullmatch(token):
            texts += [token, " " + token + token, token + "a", token + "1\n"]
    assert len(texts) > 100000
    for k in range(0, len(texts), 20000):
        for text, got in zip(texts[k : k + 20000], encode.slow.encode_batch(texts[k : k + 20000], add_special_tokens=False), strict=True):
            assert encode.ids(text).tolist()[:-1] == got.ids, text


def test_packing_retrieves_neighbours():
    import pyarrow as pa

    from plumbline.llm import textkit as tk

    texts = ["apple pear plum fig", "iron steel zinc lead", "pear plum fig apple kiwi", "zinc lead iron tin"]
    index = packing.Index(*tk.string_buffers(pa.array(texts)))
    free = np.ones(4)
    free[0] = 0
    assert index.neighbours(0, free)[0] == 2
    free[2] = 0
    assert index.neighbours(1, free)[0] in (1, 3)


def test_packing_ranks_every_document_as_brute_force(sentences):
    import pyarrow as pa

    from plumbline.llm import textkit as tk

    copies = [sentences(9, 60)] * 30  # more than a quarter of the run
    texts = copies + [sentences(900 + i, 5 + 3 * i) for i in range(50)] + ["", "alone-here"]
    docs = [Counter(words(t)) for t in texts]
    n, mean = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(w for d in docs for w in d)
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    index = packing.Index(*tk.string_buffers(pa.array(texts)))
    for q in range(n):
        norm = [packing.K1 * (1 - packing.B + packing.B * sum(d.values()) / mean) for d in docs]
        want = [sum(idf[w] * d[w] * (packing.K1 + 1) / (d[w] + norm[i]) for w in docs[q] if w in d and df[w] > 1) for i, d in enumerate(docs)]
        got = index.scores(q) / packing.UNIT
        assert all(abs(got[i] - want[i]) < 1e-3 for i in range(n) if i != q)
        free = np.ones(n)
        free[q] = 0
        order = index.neighbours(q, free)
        assert sorted(order) == [i for i in range(n) if i != q and want[i] > 0]
        assert all(got[a] > got[b] or got[a] == got[b] and a < b for a, b in zip(order, order[1:]))
    free = np.ones(n)
    free[0] = 0
    assert index.neighbours(0, free)[:29] == list(range(1, 30))


def test_packing_fills_a_window_from_all_neighbours():
    import pyarrow as pa

    from plumbline.llm import textkit as tk

    texts = [f"apple pear plum a{i}" if i % 2 else f"iron steel zinc b{i}" for i in range(64)]
    packer = packing.Packer(64, 0)
    packing.pack_shard(packer, list(range(64)), [np.ones(4, np.uint32)] * 64, packing.Index(*tk.string_buffers(pa.array(texts))))
    topics = {}
    for doc, *_, sequence, _ in packer.rows:
        topics.setdefault(sequence, set()).add(doc % 2)
    assert len(packer.rows) == 64 and all(len(t) == 1 for t in topics.values())


# 3 embeddings


@pytest.mark.parametrize("spread", [0.02, 0.1, 1.0])
def test_embedding_links_equal_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 16))
    x = np.concatenate([centers[k % 6] + spread * rng.normal(size=16) for k in range(700)]).reshape(-1, 16)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(9000, None, "a"), (9001, [0.0] * 16, "a"), (9002, [float("nan")] + [1.0] * 15, "a"), (9003, [1.0, None] + [1.0] * 14, "a"), (9004, [], "a"), (9005, [1.0, 2.0], "a"), (9006, [2.0, 4.0], "a"), (9007, [float("inf")] * 16, "a"), (9008, [1e300] * 16, "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cls string")
    got = {r["vec_id"]: r for r in embedding.link_vectors(frame).collect()}
    unit = {i: np.array(v) / np.linalg.norm(np.array(v) / np.abs(v).max()) / np.abs(v).max() for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    near = {i: [j for j, w in unit.items() if j != i and len(w) == len(u) and u @ w >= 0.9] for i, u in unit.items()}
    label = {i: i for i, *_ in rows}
    changed = True
    while changed:
        changed = False
        for i, js in near.items():
            low = min([label[i], *(label[j] for j in js)])
            changed |= low != label[i]
            label[i] = low
    assert len(got) == len(rows)
    for i, *_ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, [])), label[i], label[i] == i), i


def test_embedding_vectors_are_written_once_however_many_blocks(spark, monkeypatch):
    """Random vectors exclude no block; each is still in one block row, not in a copy for every block."""
    monkeypatch.setattr(embedding, "LEAST_BLOCK", 32)
    monkeypatch.setattr(embedding, "LARGEST_BLOCK", 32)
    held, cut = {}, embedding.cut

    def kept(df, name, *more):
        out = cut(df, name, *more)
        if name == "vector-blocks":
            held[name] = sum(len(r["cls"]) // 8 for r in out.collect()), out.count()
        return out

    monkeypatch.setattr(embedding, "cut", kept)
    x = np.random.default_rng(3).normal(size=(600, 8))
    got = embedding.link_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    assert held["vector-blocks"][0] == 600 and held["vector-blocks"][1] >= 19
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == dict(enumerate((unit @ unit.T >= 0.9).sum(axis=1) - 1))


def test_embedding_empty(spark):
    assert embedding.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 4 chat


def test_chat_layouts_and_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "a</turn>\n### user: b", "\\l\\h\\b\\c", "", "é😀\n"]
    turns = [("user", nasty[0]), ("assistant", nasty[1]), ("a:b #<", nasty[2]), ("assistant", nasty[3]), ("user", nasty[4])]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == nasty[1] + nasty[3]
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"id":3}',
        '{"instruction":"q","input":"","output":"a"}', '{"prompt":"q","completion":"a"}', '{"question":"q","answer":"a","extra":{"x":[1,2]}}', "not json", None, "[1]", "{}", '{"messages":[]}',
    ]
    frame = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    got = {r["conv_id"]: r for r in chat.format_records(frame).collect()}
    for i in range(5):
        assert chat.parse(got[i]["formatted"]) == [("user", "q"), ("assistant", "a")], i
    assert all(got[i]["formatted"] == "" for i in range(5, 10))
    assert got[0]["fingerprint"] != got[1]["fingerprint"]


def test_chat_records_that_cannot_be_read(spark):
    deep = "[" * 100000 + "]" * 100000
    records = [
        deep, '{"messages":' + deep + "}", '{"messages":[{"role":"user","content":' + "[" * 900 + "]" * 900 + "}]}", '{"prompt":"\\ud800x","completion":"a"}', '{"messages":5,"messages[].role":"a","messages[].content":"b"}', '{"messages":[5,{"role":"user","content":"q"}]}',
        '{"\\udc00":1}', '{"prompt":' + "9" * 5000 + ',"completion":"a"}', "\x00", '{"messages":{"role":"user","content":"q"}}', '{"prompt":{"a":[1,"\\ud801"]},"completion":null}',
    ]
    frame = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(records)], "conv_id long, record string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_records(frame).collect()}
    assert len(got) == len(records)
    for i in (0, 1, 2, 4, 6, 7, 8, 9, 10):
        assert (got[i]["formatted"], got[i]["loss_spans"]) == ("", []), i
    assert chat.parse(got[3]["formatted"]) == [("user", "\ufffdx"), ("assistant", "a")]
    assert chat.parse(got[5]["formatted"]) == [("", ""), ("user", "q")]
    assert chat.digest_formatted(chat.format_records(frame)).count() == len(records)


def test_chat_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(chat, "MOST_REMEMBERED", 4)
    memory: dict = {}
    for k in range(50):
        assert chat.select_layout({f"x{k}", "prompt", "completion"}, memory)[1] == "prompt_completion" and len(memory) <= 4


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, None, "x"), (2, 0, None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("record", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digest_formatted(chat.format_records(chat.records_of(frame))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\n\n").hexdigest() and got[1]["loss_chars"] == 0
    assert got[2]["n_turns"] == 2


# 5 language model


def _teach():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0


def test_lm_base_is_exact_and_states_help(docs_frame, odd_texts, sentences):
    rng = random.Random(2)
    rows = odd_texts + [(100 + i, " ".join(f"{'ab'[i % 2]}{int(rng.paretovariate(0.8)) % 300}" for _ in range(80))) for i in range(300)]
    got = lm.score_documents(docs_frame(rows), _teach()).collect()
    count, ends = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            count.update(words(t))
            count["\n"] += 1
    total, distinct = sum(count.values()), len(count)
    base = Counter()
    for i, t in rows:
        base[i] += sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*words(t), "\n"])
    mine, held = Counter(), [0.0, 0.0]
    for r in got:
        mine[r["doc_id"]] += r["base_score"]
        assert r["train_tokens"] == total and math.isfinite(r["score"]) and r["score"] <= 0
        if r["doc_id"] >= 100 and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0:
            held[0] += r["score"]
            held[1] += r["base_score"]
    assert len(got) == len(rows) and all(abs(mine[i] - base[i]) < 1e-6 * max(1, abs(base[i])) for i in base)
    assert held[0] > held[1]


def test_lm_forward_equals_enumeration():
    rng = np.random.default_rng(1)
    unigram = np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)
    model = lm.first_model(unigram)
    symbol, rows = np.array([3, 7, 3, 9], np.int32), np.array([0, 3, 3, 4])
    got = lm.forward(model, symbol, rows)
    for k, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
        v = model.start
        for j, s in enumerate([*symbol[a:b], lm.END]):
            v = (v if j == 0 else v @ model.move) * model.emit[s]
        assert abs(got[k] - math.log10(v.sum())) < 1e-4
    assert abs(model.emit.sum(axis=0) - 1).max() < 1e-9
    out = lm.empty_counts()
    lm.expected(model, [np.array([3, 7, lm.END], np.int32), np.array([5, lm.END], np.int32)], np.array([True, False]), out)
    assert abs(out["emit"].sum() - 5) < 1e-3 and abs(out["start"].sum() - 1) < 1e-4 and abs(out["move"].sum() - 3) < 1e-3
    del rng


def test_lm_expected_counts_equal_enumeration():
    rng = np.random.default_rng(3)
    unigram = rng.dirichlet(np.ones(lm.SYMBOLS))
    model = lm.first_model(unigram)
    model.start, model.mid = rng.dirichlet(np.ones(lm.STATES)), rng.dirichlet(np.ones(lm.STATES))
    model.move = rng.dirichlet(np.ones(lm.STATES), lm.STATES)
    for first in (True, False):
        seq, out = [4, 9, lm.END], lm.empty_counts()
        lm.expected(model, [np.array(seq, np.int32)], np.array([first]), out)
        begin = model.start if first else model.mid
        paths = np.einsum("i,ij,jk->ijk", begin * model.emit[seq[0]], model.move * model.emit[seq[1]], model.move * model.emit[seq[2]])
        paths /= paths.sum()
        want = np.zeros_like(out["emit"])
        for t, s in enumerate(seq):
            want[s] += paths.sum(axis=tuple(a for a in range(3) if a != t))
        assert np.abs(out["emit"] - want).max() < 1e-4
        assert np.abs(out["move"] - paths.sum(axis=2) - paths.sum(axis=0)).max() < 1e-4
        assert np.abs(out["start"] - (paths.sum(axis=(1, 2)) if first else 0)).max() < 1e-4


def test_lm_segments_count_every_token_and_transition_once():
    rng = np.random.default_rng(7)
    unigram = rng.dirichlet(np.full(lm.SYMBOLS, 0.01)) + 1e-9
    model = lm.first_model(unigram / unigram.sum())
    model.emit = model.emit * rng.gamma(0.3, 1.0, model.emit.shape) + 1e-12
    model.emit /= model.emit.sum(axis=0)
    docs = [np.append(rng.choice(lm.SYMBOLS - 1, n, p=unigram[:-1] / unigram[:-1].sum()), lm.END).astype(np.int32) for n in (1000, 127, 128, 129, 3, 0)]
    cut, whole = lm.empty_counts(), lm.empty_counts()
    lm._collect(model, docs, cut)
    for d in docs:
        lm.expected(model, [d], np.array([True]), whole)
    tokens = sum(map(len, docs))
    assert abs(cut["emit"].sum() - tokens) < 1e-2 and abs(cut["move"].sum() - (tokens - len(docs))) < 1e-2 and abs(cut["start"].sum() - len(docs)) < 1e-3
    assert np.abs(cut["move"] - whole["move"]).max() < 0.02 * whole["move"].max() and np.abs(cut["emit"] - whole["emit"]).max() < 0.5


def test_lm_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(9)
    docs = []
    for _ in range(60):
        state, doc = 0, []
        for _ in range(80):
            state = state if rng.random() < 0.9 else 1 - state
            doc.append(int(rng.integers(20)) + 20 * state)
        docs.append(np.array([*doc, lm.END], np.int32))
    unigram = np.bincount(np.concatenate(docs), minlength=lm.SYMBOLS) + 1e-6
    unigram = unigram / unigram.sum()
    symbol, rows = np.concatenate([d[:-1] for d in docs]), np.cumsum([0] + [len(d) - 1 for d in docs])
    model, said = lm.first_model(unigram), []
    for _ in range(8):
        said.append(lm.forward(model, symbol, rows).sum())
        out = lm.empty_counts()
        lm._collect(model, docs, out)
        model = lm.maximise(out, unigram)
    assert said[-1] > said[1] > said[0]


def test_lm_without_training_or_rows(docs_frame):
    got = lm.score_documents(docs_frame([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {r["score"] for r in got} == {0.0} and {r["n_tokens"] for r in got} == {3, 1}
    assert lm.score_documents(docs_frame([]), F.lit(True)).count() == 0


# 6 personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    if not re.search("[0-9@]", t):
        return out
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            odd = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and odd % 10 == 0) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(4)
    bits = ["a@b.c", "x.y@z-1.com.", "@", "..", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 555-0199", "+49", " ", "é", "\n", "7", "-", "a@b", "a@@b.c", "+1234567890123456", "é@é.com", "1..2"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(t) == brute_spans(t), t


def _private(n):
    rng = random.Random(12)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    def card():
        body = number(15)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))
    return [(100 + i, f"call +1 ({number(3)}) 555-{number(4)} or write u{i}@mail{i % 9}.example.com from 10.0.{i}.7 about {card()} ok, {i} of 99 items, ref {number(11)}") for i in range(n)]


def _pii_model(n=80):
    rows: Counter = Counter()
    for _, t in _private(n):
        rows.update(pii.examples(t))
    keys = list(rows)
    near = np.zeros((len(keys), pii.TYPES, len(pii.LABELS)))
    for k, (_, _, ties) in enumerate(keys):
        for kind, label in ties:
            near[k, kind, label] += 1
    return pii.train(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), near, np.array([rows[k] for k in keys]))


def test_pii_adds_repeats_and_nothing_else(docs_frame, odd_texts):
    whole = "call +1 555 555 0199 today. Later we sold 555 cars; card 4111 1111 1111 1111 and then room 1111 is free"
    rows = odd_texts + [(20, "card 4111 1111 1111 1111 and later 4111111111111112 no"), (21, "mail joe@x.org. Ask again: JOE@X.ORG, joe@x.org, joe (at) x (dot) org"), (22, "phone +1 555 555 0199 then 15555550199 later"), (23, "version 3. of 2024, 99 bottles"), (24, whole)]
    rows += _private(60)
    docs = docs_frame(rows)
    model = pii.fit(docs)
    got = pii.find_spans(docs, model).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        t = text[r["doc_id"]] or ""
        assert [(s["start"], [k for k, _ in PATTERNS].index(s["kind"]), s["end"]) for s in r["spans"] if s["base"]] == brute_spans(t)
    added = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if not s["base"]] for r in got}
    assert not added[20] and not added[23] and not added[24] and added[22] == ["15555550199"] and added[21] == ["joe (at) x (dot) org"]
    assert not any(added[i] for i, _ in rows[-60:])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[21] == "mail [EMAIL]. Ask again: [EMAIL], [EMAIL], [EMAIL]" and clean[23] == text[23] and clean[1] is None
    assert clean[24] == "call [PHONE] today. Later we sold 555 cars; card [CARD] and then room 1111 is free"
    digest = {r["doc_id"]: r for r in pii.digest(pii.find_spans(docs, model)).collect()}
    assert digest[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and digest[21]["n_email"] == 3


@pytest.mark.parametrize("n", [1, 6, 100])
def test_pii_labels_every_repeat(n):
    model = _pii_model()
    inside = "see x7:+14155550123 now " + "or 14155550123 and " * n + "see 415-555-0123 too"
    ((base, more),) = pii.find([inside], model)
    assert len(base) == 1 and len(more) == n + 1 and {pii.KINDS[k] for _, k, _ in more} == {"phone"}
    plain = "order 14155550123 and " * n
    pieces = "call +1 415 555 0123 now " + "then 0123 again " * n
    assert [m for _, m in pii.find([plain, "see 5 and 6", pieces], model)] == [[], [], []]


def test_pii_finds_held_out_mentions():
    """Numbers and addresses that training has not seen, masked in spellings that the patterns miss, among like numbers."""
    model, rng = _pii_model(), random.Random(99)
    right = wrong = missed = 0
    for k in range(200):
        number = "1" + "".join(rng.choice("0123456789") for _ in range(10))
        other = "1" + "".join(rng.choice("0123456789") for _ in range(10))
        mail = f"ann{k}@host{k}.example.net"
        masked = [number, f"{number[1:4]}-{number[4:7]}-{number[7:]}", mail.replace("@", " (at) ")]
        text = f"dial +{number} or {mail}; " + " then ".join(masked) + f" but not {other} nor {other[1:4]}-{other[4:7]}-{other[7:]} nor bob (at) else{k}.example.net"
        found = {text[a:b] for a, _, b in pii.find([text], model)[0][1]}
        right, wrong, missed = right + len(found & set(masked)), wrong + len(found - set(masked)), missed + len(set(masked) - found)
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.95, (right, wrong, missed)


def test_pii_reads_long_texts_in_linear_time():
    import time

    model, n = _pii_model(), 1 << 20
    for text in ("call 7 now " + "a" * n, "7@" + "a@" * (n // 2), "1" * n, "1 " * (n // 2), "+1" * (n // 2), "a (at) " * (n // 7)):
        began = time.process_time()
        pii.find([text], model)
        assert time.process_time() - began < 5


def test_pii_fits_its_pseudo_likelihood():
    rng = np.random.default_rng(2)
    shapes = np.array([[rng.integers(w) for w in pii.WIDTHS] for _ in range(40)])
    labels, n = rng.integers(0, 5, 40), rng.integers(1, 9, 40)
    near = rng.integers(0, 2, (40, pii.TYPES, 5)).astype(float)
    share = np.sqrt(n) / np.sqrt(n).sum()

    def loss(weights, ties):
        z = pii.one_hot(shapes) @ weights + np.einsum("t,rtl->rl", ties, near)
        return -(share * (z[np.arange(40), labels] - np.log(np.exp(z).sum(axis=1)))).sum() + 1e-4 * ((weights**2).sum() + (ties**2).sum())

    model = pii.train(shapes, labels, near, n, steps=3000)
    best = loss(model.weights, model.ties)
    for _ in range(20):
        assert best <= loss(model.weights + 0.02 * rng.normal(size=model.weights.shape), model.ties + 0.02 * rng.normal(size=pii.TYPES))


def test_pii_messages_are_exact_on_trees():
    rng = np.random.default_rng(6)
    for trial in range(3):
        model = pii.Model(rng.normal(size=(pii._FIRST[-1] + 1, len(pii.LABELS))), np.array([1.0, 6.0, 9.0, 3.0]))
        shapes = np.array([[rng.integers(w) for w in pii.WIDTHS] for _ in range(5)])
        clamped = np.array([0, 0, 2 * trial, 0, 0])
        edges = np.array([(5, 0, 1), (5, 1, 1), (5, 2, 3), (2, 3, 2), (3, 4, 0)])
        unary = pii.one_hot(shapes) @ model.weights
        if clamped[2]:
            unary[2] = np.where(np.arange(5) == clamped[2], 0, -200.0)
        want = np.zeros((6, 5))
        for x in np.ndindex(*[5] * 6):
            p = math.exp(sum(unary[i, x[i]] for i in range(5)) + sum(model.ties[t] for i, j, t in edges if x[i] == x[j]))
            for i in range(6):
                want[i, x[i]] += p
        got = pii.infer(model, shapes, clamped, edges, 1)
        want /= want.sum(axis=1, keepdims=True)
        free = [i for i in range(6) if i > 4 or not clamped[i]]
        assert np.abs(got - want)[free].max() < 0.01


# 7 toxicity


def test_toxicity_learns_and_leaves_clean_texts(docs_frame, odd_texts, spark, sentences):
    rng = random.Random(6)
    rows = [(100 + i, sentences(i, 60) + (" " + " ".join(rng.choice(["vile", "rotten", "filthy"]) for _ in range(4)) if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(k % 4 == 0)) for k, (i, _) in enumerate(rows)] + [(100, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    docs = docs_frame(rows + odd_texts)
    model = toxicity.fit(docs, labels, teach=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score_documents(docs, model).collect()}
    held = [(i, k % 4 == 0) for k, (i, _) in enumerate(rows) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bad for i, bad in held) >= 0.97 * len(held)
    assert got[1] == got[2] == got[3] and 0 <= got[5] <= 1
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 7").count() == 2
    assert toxicity.keep_clean(docs, None).count() == docs.count()


def test_toxicity_training_equals_plain_ftrl(sentences):
    import pyarrow as pa

    rng = random.Random(5)
    texts = [sentences(i, 12, 60) + (" vile" if i % 3 == 0 else "") for i in range(60)] + ["", "one"]
    labels = [int(i % 3 == 0) for i in range(60)] + [0, 1]
    model = toxicity.train(pa.array(texts), labels, epochs=3)
    rows = []
    for text in texts:
        found = [int(x) for places, _ in toxicity.features(*toxicity.tk.string_buffers(pa.array([text]))) for x in places]
        rows.append({k: n / math.sqrt(len(found)) for k, n in Counter(found).items()})
        assert len(found) == sum(max(len(words(text)) - gap, 0) for gap in (0, 1, 2))
    alpha, beta, l1, l2 = 20.0, 1.0, 0.6, 0.01
    z, n = Counter(), Counter()
    rate = min(max(sum(labels) / len(labels), 0.001), 0.4)
    bias = math.log(rate / (1 - rate))

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(3):
        for row, y in zip(rows, labels, strict=True):
            w = {k: weight(k) for k in row}
            g = 1 / (1 + math.exp(-(bias + sum(w[k] * x for k, x in row.items())))) - y
            for k, x in row.items():
                step = (math.sqrt(n[k] + (g * x) ** 2) - math.sqrt(n[k])) / alpha
                z[k] += g * x - step * w[k]
                n[k] += (g * x) ** 2
    want = {k: weight(k) for k in z if weight(k)}
    got = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want) and abs(model.bias - bias) < 1e-12
    scores = toxicity.scores(model.dense(), model.bias, *toxicity.tk.string_buffers(pa.array(texts)))
    for row, got_score in zip(rows, scores, strict=True):
        assert abs(got_score - 1 / (1 + math.exp(-(bias + sum(want.get(k, 0) * x for k, x in row.items()))))) < 1e-5
    del rng


# 8 decontamination


def brute_leaks(rows, items):
    """(document, item) pairs by the rule alone: words in sets, no index."""
    out = set()
    for d, t in rows:
        w = letters(t)
        grams, seen = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}, set(w)
        for i, it in items:
            iw = letters(it)
            if not iw:
                continue
            own = {tuple(iw[k : k + 5]) for k in range(len(iw) - 4)} or {tuple(iw)}
            here = sum(g in grams for g in own) if len(iw) >= 5 else int(any(tuple(w[k : k + len(iw)]) == tuple(iw) for k in range(len(w))))
            sentence = re.split(r"[.!?\n]", it.rstrip().rstrip(".!?"))
            last = len(letters(sentence[-1])) if len(sentence) > 1 else 0
            last = last if 0 < last < len(iw) else max(1, len(iw) // 4)
            asked, answer = iw[: len(iw) - last], set(iw[len(iw) - last :])
            question = {tuple(asked[k : k + 5]) for k in range(len(asked) - 4)}
            if here >= 0.8 * len(own) and sum(g in grams for g in question) >= 0.5 * len(question) and (last < 5 or len(answer & seen) >= 0.5 * len(answer)):
                out.add((d, i))
    return out


def test_decontamination_equals_brute_force(docs_frame, odd_texts, spark, sentences, monkeypatch):
    rng = random.Random(8)
    items = [(i, sentences(1000 + i, 8 + i % 60) + ". " + sentences(2000 + i, 6)) for i in range(80)] + [(90, None), (91, "  "), (92, "three word item"), (93, sentences(5000, 400))]
    rows = list(odd_texts)
    for k in range(150):
        own = sentences(7000 + k, 200 + k)
        item = items[k % 84][1] or ""
        w = item.split()
        cut = w if k % 3 == 0 else w[: int(len(w) * rng.random())] if k % 3 == 1 else [x if rng.random() > 0.02 else "zz" for x in w]
        at = rng.randint(0, len(own))
        cut = [x.upper() + "!!" for x in cut] if k % 5 == 0 else cut
        rows.append((1000 + k, own[:at] + " " + " ".join(cut) + " " + own[at:]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    shards = decontaminate.index(bench)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_frame(rows), shards).collect()}
    want = brute_leaks(rows, items)
    assert got == want and len(want) > 40
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 600)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 1 << 14)
    many = decontaminate.index(bench)
    assert len(many.passes) > 1
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_frame(rows), many).collect()} == want
    assert {r["doc_id"] for r in decontaminate.clean_documents(docs_frame(rows), many).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    clean = decontaminate.clean_documents(docs_frame(rows), shards)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.find_leaks(docs_frame(rows), decontaminate.index(bench.where("false"))).count() == 0


def test_decontamination_of_near_copies_without_a_short_answer(docs_frame, spark, sentences):
    short, long = sentences(31, 40), sentences(32, 60)
    items = [(1, short + ". seven dwarfs"), (2, long + ". one whole sentence for an answer"), (None, sentences(33, 30))]
    rows = [(1, "a " + short + " b"), (2, "a " + long + " b"), (3, "a " + items[1][1] + " b"), (4, "seven dwarfs " + " ".join(short.split()[:20])), (5, items[2][1])]
    shards = decontaminate.index(spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_frame(rows), shards).collect()}
    assert got == {(1, 1), (3, 2), (5, None)}


# 9 n-gram Jaccard


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])))
    label = {i: i for i, _ in rows}
    links = [(i, j) for a, (i, s) in enumerate(sets) for j, u in sets[a + 1 :] if s and u and 100 * len(s & u) >= 80 * len(s | u)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return {i: (len(s), label[i]) for i, s in sets}


def test_jaccard_equals_brute_force(docs_frame, odd_texts, sentences, monkeypatch):
    for name, small in (("BLOCK", 16), ("HOT", 40), ("CHUNK", 16), ("PART", 8), ("SALT", 8), ("HEAVY_LEAST", 8)):
        monkeypatch.setattr(jaccard, name, small)
    rng = random.Random(9)
    passage = sentences(4242, 60)
    rows = list(odd_texts)
    for g in range(25):
        base = sentences(100 + g, 20 + 13 * g).split()
        for k in range(2 + (60 if g == 3 else g % 6)):
            w = [x if rng.random() > 0.008 * (k % 5) else f"q{rng.randint(0, 9999)}" for x in base]
            rows.append((1000 + 100 * g + k, " ".join(w)))
    rows += [(9000 + k, passage + " " + sentences(3000 + k, 10 + 3 * k)) for k in range(60)]
    rows += [(9500 + k, "a b c".split()[k % 3]) for k in range(6)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs_frame(rows)).collect()}
    assert got == brute_components(rows)
    kept = jaccard.keep_representatives(docs_frame(rows))
    ids = [r["doc_id"] for r in kept.collect()]
    want = {i for i, (_, c) in got.items() if i == c}
    assert sorted(ids) == sorted(want)


def test_jaccard_empty(docs_frame):
    assert jaccard.jaccard_components(docs_frame([])).count() == 0
    assert jaccard.keep_representatives(docs_frame([(1, None), (2, None)])).count() == 2


# 10 sharding


def brute_capacity(sizes, shards):
    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("hot", [1, 400])
def test_sharding_is_minimax(docs_frame, odd_texts, sentences, spark, hot, monkeypatch):
    monkeypatch.setattr(sharding, "COARSE_SHIFT", 60)  # few ranges, so that levels are refined
    rows = odd_texts + [(100 + i, sentences(i, i % 50)) for i in range(600)] + [(5000 + i, "hot text") for i in range(hot)]
    docs = docs_frame(rows)
    got = sharding.shard_rows(docs, 16).collect()
    assert len(got) == len(rows)
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"))
    groups = keyed.groupBy("key").agg(F.sum("size").alias("size"))
    sizes = [r["size"] for r in groups.orderBy("key").collect()]
    capacity, _ = sharding.capacity_and_cuts(groups, 16)
    total = Counter()
    slots = {}
    for r in got:
        total[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert capacity == brute_capacity(sizes, 16) and max(total.values()) <= capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = {}
    for r in got:
        t = next(t for i, t in rows if i == r["doc_id"])
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert where.setdefault(t or "", r["shard"]) == r["shard"]


def test_sharding_empty(docs_frame):
    assert sharding.shard_rows(docs_frame([]), 16).count() == 0
