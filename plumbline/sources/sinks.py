"""Writers of documents and logs, by Spark's own commit protocol: what a task wrote counts once its job has committed.

A retried task replaces its own attempt, so nothing is written twice, and a reader never sees half a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "lines"


def write_documents(documents: DataFrame, path: str, by: str, document_col: str = "document") -> None:
    """One folder a project (``by=<value>``) with its documents as text, one a line; projects written before are replaced, others stay.

    Documents are put on one line: JSON stays the same under that. Null documents are left out. Nothing is gathered: each
    document is a row, and goes to the task that holds its project.
    """
    flat = F.regexp_replace(F.col(document_col), r"\r\n|\n|\r", " ")
    rows = documents.where(F.col(document_col).isNotNull()).select(F.col(by), flat.alias("value"))
    rows.repartition(by).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def read_documents(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(by, document) of what was written, values of ``by`` as text."""
    rows = spark.read.schema(f"value string, `{by}` string").option("wholetext", False).text(path)
    return rows.select(by, F.col("value").alias("document"))


def append_lines(rows: DataFrame, path: str, run: str) -> None:
    """Append rows to a log of JSON lines, as the part of ``run``; writing the same run again replaces its part."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(f"{path.rstrip('/')}/run={run}")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All whole rows of a log of JSON lines; torn or foreign lines are skipped."""
    text = spark.read.schema("value string").text(path).select("value")
    fields = [x.split()[0] for x in schema.split(",")]
    parsed = text.select(F.from_json("value", f"{schema}, _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"))
    return parsed.where("r is not null and r._torn is null").select(*[F.col(f"r.{f}").alias(f) for f in fields])
