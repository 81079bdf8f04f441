"""Intermediate tables in the cluster's shared folder: a lost executor costs a reread, no lineage grows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/plumbline-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write_table(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder, in folders by the columns ``by``; return what reads it, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def write_buckets(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """Write ``df`` once in the shared folder, in buckets by ``cols`` as shuffles deal them: joins by ``cols`` do not shuffle it.

    ``drop_buckets`` removes it.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *cols).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table).alias(table)


def drop_buckets(df: DataFrame) -> None:
    """Remove a table of ``write_buckets`` that nothing reads any more."""
    spark, paths = df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1]}")
        drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, *cols: str, each: int = 8) -> DataFrame:
    """``df`` dealt by ``cols`` over ``each`` tasks a partition of its own: what a task holds does not grow with the input.

    Made for frames that are read and not yet shuffled, whose partitions grow in number with their files.
    """
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, each * df.rdd.getNumPartitions()), *cols)
