"""Target-distribution importance resampling: documents whose hashed n-grams look like a target's are drawn more often.

Equal texts are collapsed by grouping the full text, which is tokenised and hashed once; counts are multiplied by how
often it occurs. A feature is a run of 1 to ``longest`` words joined by one space, and its bucket the CRC-32 of its UTF-8
bytes modulo ``buckets``. A bucket's gain is floor(1000 ln) of its smoothed share in the target over that in the corpus;
a text's weight is the sum of its features' gains, computed once and joined back by the text's SHA-256. Gumbel noise from
each document's own id then makes the highest scores a draw without replacement in proportion to the weights.

The driver and every executor hold two numbers a bucket, whatever the input. A text's copies meet only as one row a task
(they are combined before the shuffle), and the join back is an equi-join whose hot keys adaptive execution splits. The
draw is exact: rows are sorted by ranges, and a rank is a row's place in its range after the sizes of the ranges before.

A null text counts as an empty one: no words, weight 0. A null id has the noise of an empty id. Texts of any length are
read whole, a word of any length too. Ties go to the smaller id, null ids last; repeated rows get ranks of their own.
An empty target leaves the smoothed uniform one; an empty corpus gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import cut

LONG = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def crc32(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[start:end] for all spans: a byte of every span at a time, the few long ones by themselves."""
    out = np.zeros(len(starts), np.uint32)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    size = size[order]
    far = int(np.searchsorted(-size, -LONG))
    for i in order[:far]:
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    order, size = order[far:], size[far:]
    at, state = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))  # spans longer than k come first
        now = state[:n]
        state[:n] = _TABLE[(now ^ raw[at[:n] + k]) & 255] ^ (now >> 8)
    out[order] = ~state
    return out


def features(raw: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, n+1 offsets into them by row, and the number of words of each row."""
    _, rows, starts, ends = tk.words(raw, offsets, spans=True, letters=True)
    length = ends - starts
    begin = np.cumsum(length + 1) - length - 1
    line = np.full(int((length + 1).sum()), 32, np.uint8)  # all words, parted by one space
    if len(length):
        line[np.arange(len(line) - len(length)) + np.repeat(np.arange(len(length)), length)] = tk._LOWER[raw[np.arange(int(length.sum())) + np.repeat(starts - np.cumsum(length) + length, length)]]
    row, found, owner = tk.row_index(rows), [], []
    for n in range(1, longest + 1):
        first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
        found.append(crc32(line, begin[first], begin[first + n - 1] + length[first + n - 1]) % np.uint32(buckets))
        owner.append(row[first])
    found, owner = np.concatenate(found), np.concatenate(owner)
    if longest > 1:
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found.astype(np.int32), np.searchsorted(owner, np.arange(len(offsets))), np.diff(rows)


def _distinct(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(key, copies, words, buckets): every distinct text once, with the buckets of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            found, at, words = features(*tk.string_buffers(part.column(2)), longest, buckets)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words), lists], ["key", "copies", "words", "buckets"])

    grouped = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(_key(F.col("text")).alias("key"), "copies", "text")
    return grouped.mapInArrow(run, "key binary, copies long, words long, buckets array<int>")


def _key(text):
    return F.unhex(F.sha2(text, 256))


def _counts(distinct: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts, copies included: ``buckets`` numbers reach the driver."""
    out = np.zeros(buckets, np.int64)
    for x in distinct.select("copies", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias("n")).collect():
        out[x.bucket] = x.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + b) / ((s + 1)(T + b)))) for each of b buckets."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def _weights(distinct: DataFrame, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            weight = tk.sum_by_row(sent.value[lists.values.to_numpy()[at[0] : at[-1]]], at - at[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(weight, pa.int64())], ["key", "words", "n_features", "weight"])

    return distinct.select("key", "words", "buckets").mapInArrow(run, "key binary, words long, n_features long, weight long")


def weigh(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, n_features, weight) for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    corpus = cut(_distinct(docs.select(text.alias("text")), longest, buckets), "distinct-texts")
    wanted = _counts(_distinct(target.select(text.alias("text")), longest, buckets), buckets)
    sent = docs.sparkSession.sparkContext.broadcast(gains(_counts(corpus, buckets), wanted))
    return docs.select(F.col(id_col).alias("doc_id"), _key(text).alias("key")).join(_weights(corpus, sent), "key").select("doc_id", "words", "n_features", "weight")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, longest: int = 1, buckets: int = 10000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document; rank is null for those that are not drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weigh(docs, target, longest, buckets, id_col, text_col).withColumn("score", (F.col("weight") + noise).cast("long")), "importance")
    may = F.col("words") >= least_words
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    sorted_rows = cut(scored.where(may).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "importance-order")
    within = F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((x.range, x.n) for x in sorted_rows.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for k, n in sizes:
        starts.append((k, before))
        before += n
    ranges = F.broadcast(docs.sparkSession.createDataFrame(starts, "range long, before long"))  # a row a partition
    rank = F.col("before") + within + 1
    drawn = sorted_rows.join(ranges, F.shiftright("place", 33) == F.col("range")).withColumn("rank", F.when(rank <= percent * before // 100, rank))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return drawn.select(*columns).unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")).select(*columns))
