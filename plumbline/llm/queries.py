"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_mod(n: int):
    """crc32 of the id's decimal text modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, teach=_id_mod(3) != 1)
    return langid.identify(docs, model).select("doc_id", (_id_mod(3) == 1).alias("held_out"), "lang_pred", "score")


def tokenizer_files() -> tuple:
    """The public byte-level vocabulary: tokenizer file, the same as ranks, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_files())


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding

    return embedding.link_vectors(_table(spark, sf_dir, "embeddings"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    text = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digest_formatted(chat.format_records(chat.records_of(rows))).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written down in five layouts (by id) and read back: what the mapping selection has to undo."""
    from . import chat

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    whole = rows.groupBy("conv_id").agg(turns.alias("t"))

    def first(role: str):
        return F.coalesce(F.get(F.filter("t", lambda x: x["role"] == role), F.lit(0))["text"], F.lit(""))

    told = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    layouts = [
        F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"), F.lit("x").alias("source")),
        F.struct(F.col("conv_id").alias("id"), F.transform("t", lambda x: F.struct(F.coalesce(told[x["role"]], x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")),
        F.struct(F.struct(F.lit("x").alias("lang")).alias("meta"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")),
        F.struct(first("user").alias("instruction"), first("system").alias("input"), first("assistant").alias("output")),
        F.struct(first("user").alias("prompt"), first("assistant").alias("completion"), F.lit(1).alias("score")),
    ]
    kind = F.pmod(F.col("conv_id"), F.lit(len(layouts)))
    record = F.coalesce(*[F.when(kind == k, F.to_json(x)) for k, x in enumerate(layouts)])
    return chat.digest_formatted(chat.format_records(whole.select("conv_id", record.alias("record")))).select(
        "conv_id", "layout", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    got = lm.score_documents(_table(spark, sf_dir, "documents"), teach=_id_mod(10) != 0)
    return got.select("doc_id", (_id_mod(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_spans(docs, pii.fit(docs)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, teach=_id_mod(5) != 0)
    return toxicity.score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id", (_id_mod(5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted")
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    shards = decontaminate.index(_table(spark, sf_dir, "benchmark"))
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), shards)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard_rows(_table(spark, sf_dir, "documents"), 16)


def op11_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(_table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 50 == 0)


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import search

    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import importance

    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_packing, op3_embedding_near_dedup, op4_chat_formatting, op5_lm_scoring, op6_pii, op7_toxicity, op8_benchmark_decontamination, op9_ngram_jaccard, op10_sharding, op11_exact_topk_search, op12_ranked_lexical_search, op13_importance_resampling, chat_layouts)}

ORACLES = {
    "chat_layouts": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
f AS (SELECT conv_id, ((conv_id % 5) + 5) % 5 AS k, list({'role': role, 'text': text} ORDER BY turn, role, text) AS t,
  coalesce(first(text ORDER BY turn, text) FILTER (WHERE role = 'user'), '') AS u,
  coalesce(first(text ORDER BY turn, text) FILTER (WHERE role = 'system'), '') AS s,
  coalesce(first(text ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS a FROM r GROUP BY conv_id),
g AS (SELECT conv_id, k, CASE WHEN k < 3 THEN t
  ELSE [{'role': 'user', 'text': u || CASE WHEN k = 3 AND s <> '' THEN chr(10) || s ELSE '' END}, {'role': 'assistant', 'text': a}] END AS t FROM f)
SELECT conv_id, ['messages', 'from_value', 'turns', 'instruction_input', 'prompt_completion'][k + 1] AS layout,
  CAST(len(t) AS BIGINT) AS n_turns, sha256(array_to_string(list_transform(t, lambda x: x.role || chr(10) || x.text || chr(10)), '')) AS turns_sha256,
  CAST(length(array_to_string(list_transform(list_filter(t, lambda x: x.role = 'assistant'), lambda x: x.text), '')) AS BIGINT) AS loss_chars,
  sha256(array_to_string(list_transform(list_filter(t, lambda x: x.role = 'assistant'), lambda x: x.text), '')) AS loss_sha256
FROM g""",
    "op3_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
w AS (SELECT row_number() OVER () AS row, vec_id, list_transform(e, lambda x: x / n) AS e FROM u),
l AS (SELECT a.row AS x, b.row AS y, a.vec_id AS a, b.vec_id AS b FROM w a, w b
  WHERE a.row <> b.row AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach AS (SELECT DISTINCT a, b FROM l WHERE b < a UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(m.b, v.vec_id)) AS kept
FROM v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = v.vec_id""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
q AS (SELECT r, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT r, n, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g FROM q WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT DISTINCT r, g FROM t WHERE i <= n - 4 OR n < 5 AND i = 1),
f AS (SELECT r, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY r),
c AS (SELECT k, min(doc_id) AS low, min(r) AS r, any_value(n) AS n FROM f JOIN d USING (r) GROUP BY k),
p AS (SELECT c.low, c.n, s.g FROM c JOIN s USING (r)),
l AS (SELECT a.low AS a, b.low AS b FROM p a JOIN p b ON a.g = b.g AND a.low < b.low AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.low, b.low, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(f.n, 0) AS n_shingles, least(coalesce(c.low, d.doc_id), coalesce(m.b, c.low, d.doc_id)) AS component_id
FROM d LEFT JOIN f USING (r) LEFT JOIN c ON c.k = f.k LEFT JOIN m ON m.a = c.low""",
    "op4_chat_formatting": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + 3 * length(text) - length(replace(text, '\', '')) - length(replace(text, '<', ''))
    - length(replace(text, '#', ''))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id""",
    "op11_exact_topk_search": r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score, c.r AS c
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, c) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5""",
    "op12_ranked_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark WHERE text IS NOT NULL),
z AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT i, item_id, unnest(w) AS t FROM b),
p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t),
k AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT n FROM z) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f GROUP BY t),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(k.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * f.n * z.n) // z.l)))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN k USING (t), z GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op13_importance_resampling": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
f AS (SELECT r, unnest(w) AS x FROM d),
step AS (SELECT list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c, n FROM (SELECT unnest(range(256)) AS n)),
tab AS (SELECT list(c ORDER BY n) AS c FROM step),
words AS (SELECT DISTINCT x FROM (SELECT x FROM f UNION ALL SELECT x FROM b)),
k AS (SELECT x, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(hex(encode(x))), 2), lambda i: CAST('0x' || substr(hex(encode(x)), CAST(i AS INTEGER), 2) AS BIGINT))),
  lambda c, y: xor(c >> 8, tab.c[(xor(c, y) & 255) + 1]))) % 10000 AS u FROM words, tab),
s AS (SELECT u, count(*) AS n FROM f JOIN k USING (x) GROUP BY u), t AS (SELECT u, count(*) AS n FROM b JOIN k USING (x) GROUP BY u),
z AS (SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM b) AS t),
g AS (SELECT k.x, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (CAST(z.s AS DOUBLE) + 10000) / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * (CAST(z.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM k LEFT JOIN s USING (u) LEFT JOIN t USING (u), z),
m AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN g USING (x) GROUP BY r),
o AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN m ON m.r = d.r),
e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank, count(*) OVER () AS n FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (10 * n) // 100 THEN rank END AS rank FROM o LEFT JOIN e USING (r)""",
}
