"""Deal the queries of a query set into passes of bounded size, so that each can be sent to all executors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(queries: DataFrame, key: str, size: str, most: int) -> tuple[DataFrame, int]:
    """``queries`` with a column ``pass``, and how many passes there are: none holds more than ``most`` bytes, measured.

    All rows of one key share a pass, so one key that is larger by itself has a pass of its own size. Keys are dealt by
    hash; the driver sees two numbers a try, and tries end once each pass fits or holds a single key.
    """
    total = queries.agg(F.sum(size)).first()[0] or 0
    count = max(1, math.ceil(1.25 * total / most))
    while True:
        dealt = queries.withColumn("pass", F.pmod(F.xxhash64(key, F.lit(count)), F.lit(count)).cast("int"))
        if count == 1 and total <= most:
            return dealt, count if total else 0
        keys = dealt.groupBy("pass", key).agg(F.sum(size).alias("bytes"))
        over = keys.groupBy("pass").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("keys")).where((F.col("bytes") > most) & (F.col("keys") > 1))
        if over.isEmpty():
            return dealt, count
        count *= 2
