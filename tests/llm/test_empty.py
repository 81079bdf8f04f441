from __future__ import annotations

from plumbline.llm import chat, decontaminate, langid, lm, packing, pii, toxicity
from plumbline.llm.queries import tokenizer_files
from pyspark.sql import functions as F


def test_empty_tables(spark, docs_frame):
    docs = docs_frame([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert langid.identify(docs, langid.fit(docs)).count() == 0
    assert packing.pack(docs, tokenizer_files()).count() == 0
    assert lm.score_documents(docs, F.lit(True)).count() == 0
    model = pii.fit(docs)
    assert pii.digest(pii.find_spans(docs, model)).count() == 0 and pii.redact(docs, model).count() == 0
    clean = toxicity.fit(docs, labels)
    assert clean is None and toxicity.score_documents(docs, clean).count() == 0
    assert decontaminate.clean_documents(docs, decontaminate.index(spark.createDataFrame([(1, "some item of words here")], "item_id long, text string"))).count() == 0
    assert chat.digest_formatted(chat.format_records(chat.records_of(spark.createDataFrame([], "conv_id long, turn int, role string, text string")))).count() == 0


def test_models_without_signal_leave_documents_alone(spark, docs_frame):
    rows = [(1, None), (2, "plain words"), (3, "a@b.org")]
    docs = docs_frame(rows)
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(docs, toxicity.fit(docs, labels)).count() == 3
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.fit(docs)).collect()}
    assert got == {1: None, 2: "plain words", 3: "[EMAIL]"}
    assert decontaminate.clean_documents(docs, decontaminate.index(spark.createDataFrame([], "item_id long, text string"))).count() == 3
