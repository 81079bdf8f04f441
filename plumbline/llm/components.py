"""Connected components by alternating large-star and small-star steps over written edge tables.

Nothing but counts and checksums reaches the driver. Minima are pre-aggregated before each shuffle, so a hub costs one
row a task there; the joins back are plain equi-joins, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_table, write_table


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs: (node, root) for every node of an edge, root being the least node of its component."""
    spark = edges.sparkSession
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges, path = write_table(edges, "edges")
    seen = _mark(edges)
    while seen[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        after = (
            large.join(small, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct()
        )
        after, new_path = write_table(after, "edges")
        drop_table(spark, path)
        edges, path = after, new_path
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
