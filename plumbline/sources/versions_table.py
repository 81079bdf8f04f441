"""A keyed table that grows by committed deltas: the newest row of a key holds, old ones expire, and compaction merges.

A delta is a folder that counts once Spark has committed it (its success mark is there), so a failed or repeated task leaves
nothing half-written, and writing the same run again replaces its delta. Readers see the deltas committed when they ask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_DELTAS = 16


class KeyedTable:
    """``path`` holds rows (``key`` columns, ``values`` columns, ``at`` seconds); ``schema`` is the DDL of keys and values."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], keep_seconds: int | None = None):
        self.spark, self.path, self.key, self.keep = spark, path.rstrip("/"), key, keep_seconds
        self.schema = f"{schema}, at long"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Folders of the deltas that count."""
        path, files = self._files()
        if not files.exists(path):
            return []
        found = [x.getPath() for x in files.listStatus(path) if x.isDirectory()]
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(str(p.toString()) for p in found if files.exists(mark(p, "_SUCCESS")))

    def rows(self, now: int | None = None) -> DataFrame:
        """The newest row of each key, without those that have expired at ``now``."""
        deltas = self.committed()
        every = self.spark.read.schema(self.schema).parquet(*deltas) if deltas else self.spark.createDataFrame([], self.schema)
        if now is not None and self.keep is not None:
            every = every.where(F.col("at") > now - self.keep)
        rest = [c for c in every.columns if c not in self.key]
        newest = every.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct("at", F.xxhash64(*rest))).alias("r"))  # combined before the shuffle
        return newest.select(*self.key, "r.*")

    def put(self, rows: DataFrame, run: str, at: int) -> None:
        """Commit one row a key of ``rows`` as the delta of ``run``; merge deltas when there are many."""
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields if f.name != "at"]
        rows.select(*columns).dropDuplicates(self.key).withColumn("at", F.lit(at).cast("long")).write.mode("overwrite").parquet(f"{self.path}/delta-{run}")
        if len(self.committed()) > MOST_DELTAS:
            self.compact(at, run)

    def compact(self, now: int, run: str) -> None:
        """One delta with what holds at ``now`` in place of all that are committed; expired rows go for good."""
        old = self.committed()
        self.rows(now).write.mode("overwrite").parquet(f"{self.path}/merged-{run}")
        _, files = self._files()
        for folder in old:
            if not folder.endswith(f"/merged-{run}"):
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
