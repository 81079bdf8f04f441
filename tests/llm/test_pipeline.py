from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from test_llm_operators import brute_components, brute_leaks, brute_spans

import corpus_pipeline
from plumbline.llm import packing, toxicity


def test_stages_on_planted_documents(spark, docs_frame, sentences, tmp_path):
    rng = random.Random(1)
    clean = [(i, sentences(i, 120)) for i in range(100, 300)]
    toxic = [(i, sentences(i, 100) + " vile rotten filthy vile rotten") for i in range(300, 380)]
    copies = [(400, clean[0][1]), (401, clean[1][1] + " tail")]
    items = [(i, sentences(8000 + i, 40)) for i in range(10)]
    leaks = [(500 + i, sentences(9000 + i, 80) + " " + items[i][1]) for i in range(10)]
    private = [(600, sentences(77, 50) + " write to joe@mail.example.org now")]
    odd = [(1, None), (2, ""), (2, ""), (3, "one")]
    folder = str(tmp_path / "in")
    docs_frame(clean + toxic + copies + leaks + private + odd).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.store.cut(stage(spark, docs, folder), name)
        seen[name] = docs
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    ids = {n: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for n, df in seen.items()}
    assert not set(range(300, 380)) & set(ids["toxicity"]) and set(range(100, 300)) <= set(ids["toxicity"])
    assert 400 not in ids["ngram_jaccard_join"] and 401 not in ids["ngram_jaccard_join"] and ids["ngram_jaccard_join"].count(2) == 1
    assert set(range(100, 300)) <= set(ids["ngram_jaccard_join"])
    assert not set(range(500, 510)) & set(ids["benchmark_decontamination"]) and set(range(100, 300)) <= set(ids["benchmark_decontamination"])
    assert "[EMAIL]" in seen["pii"].where("doc_id = 600").first()["text"] and seen["pii"].count() == seen["benchmark_decontamination"].count()
    assert set(ids["packing"]) == set(ids["pii"])
    assert corpus_pipeline.run(spark, folder).count() == seen["packing"].count()
    del rng


def test_pipeline_equals_brute_force(spark, docs_frame, sentences, tmp_path):
    """Every stage against the plain rule on the rows that its predecessor kept."""
    rng = random.Random(3)
    rows = [(i, sentences(i, 30 + i % 90)) for i in range(100, 220)]
    rows += [(i, sentences(i, 80) + " vile rotten filthy vile rotten") for i in range(300, 340)]
    rows += [(400 + k, " ".join(w if rng.random() > 0.004 * (k % 4) else "zz" for w in rows[k % 20][1].split())) for k in range(60)]
    items = [(i, sentences(8000 + i, 20 + i)) for i in range(8)]
    rows += [(500 + i, sentences(9000 + i, 60) + " " + " ".join(x if rng.random() > 0.02 * (i % 3) else "zz" for x in items[i % 8][1].split())) for i in range(24)]
    rows += [(600 + i, sentences(700 + i, 30) + f" write to u{i}@mail.example.org or +1 (555) 555-01{i:02d} now") for i in range(12)]
    rows += [(1, None), (2, ""), (2, ""), (3, "one")]
    folder = str(tmp_path / "brute")
    docs_frame(rows).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(300 <= i < 340)) for i, _ in rows if 100 <= i < 340], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)]
    for name in list(stages)[:-1]:
        docs = corpus_pipeline.store.cut(stages[name](spark, docs, folder), name)
        seen.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr))
    start = spark.read.parquet(f"{folder}/documents.parquet")
    from pyspark.sql import functions as F

    model = toxicity.fit(start, labels, teach=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    weights = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))

    def score(text):
        import pyarrow as pa

        found = [int(x) for places, _ in toxicity.features(*toxicity.tk.string_buffers(pa.array([text or ""]))) for x in places]
        return model.bias + sum(weights.get(k, 0.0) * n for k, n in Counter(found).items()) / max(len(found), 1) ** 0.5

    assert seen[1] == [x for x in seen[0] if score(x[1]) < 0] and len(seen[1]) < len(seen[0])
    label = brute_components(seen[1])
    assert seen[2] == sorted({x for x in seen[1] if label[x[0]][1] == x[0]}, key=repr) and len(seen[2]) < len(seen[1])
    leaked = {d for d, _ in brute_leaks(seen[2], items)}
    assert seen[3] == [x for x in seen[2] if x[0] not in leaked] and leaked
    kinds = ("EMAIL", "IP", "CARD", "PHONE")

    def redacted(text):
        if text is None:
            return None
        out, done = [], 0
        for s, k, e in brute_spans(text):
            if s >= done:
                out += (text[done:s], f"[{kinds[k]}]")
            done = max(done, e)
        return "".join(out) + text[done:]

    assert seen[4] == sorted(((i, redacted(t)) for i, t in seen[3]), key=repr) and any("[PHONE]" in (t or "") for _, t in seen[4])
    encode = packing.encoder(*corpus_pipeline.tokenizer_files())
    pieces = [r.asDict() for r in corpus_pipeline.pack_sequences(spark, docs, folder).collect()]
    want = {i: np.append(encode.slow.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4") for i, t in seen[4]}
    covered = {i: np.zeros(len(x), int) for i, x in want.items()}
    for p in pieces:
        covered[p["doc_id"]][p["start"] : p["start"] + p["length"]] += 1
        assert p["ids_crc32"] == zlib.crc32(want[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    assert all((c == 1).all() for c in covered.values())
    assert sorted((p["doc_id"], p["start"], p["length"]) for p in pieces) == sorted((r["doc_id"], r["start"], r["length"]) for r in corpus_pipeline.run(spark, folder).collect())


def test_pipeline_on_empty_tables(spark, docs_frame, tmp_path):
    folder = str(tmp_path / "none")
    docs_frame([]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
