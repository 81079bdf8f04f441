"""Minimax contiguous partition of rows into shards of nearly equal bytes.

Rows with equal texts form an atomic group; groups are ordered by a 64-bit hash of their text. The smallest feasible
shard capacity is found by binary search with a greedy check over ordered group sizes, then the order is cut there.
The driver never sees all groups: it starts from the sums of 2**16 ranges of the order and splits, by 8 bits at a time,
only those ranges in which a cut for some capacity that is still possible may fall. A level therefore brings at most a
few hundred ranges times 256 sums to the driver, whatever the input, and the capacity found is exact.

Within the least capacity cuts are then placed as evenly as it allows (a hot group may make it large).
Nulls: a null text counts as an empty one (size 1, CRC 0). Empty input: no rows. Ties: rows with one text share a shard
and get different slots. Texts of any length count whole. Other columns of the input are left alone and ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

COARSE_SHIFT = 48
DEAL = 256


def _greedy(ends: np.ndarray, capacity: int, most: int) -> list[int] | None:
    """Cut positions (unit indexes) of the greedy packing of atomic units, or None if it needs more than ``most`` shards."""
    at, cuts, n = 0, [], len(ends)
    while at < n:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + capacity, "right"))
        if to == at or len(cuts) == most:
            return None
        cuts.append(to)
        at = to
    return cuts


def _least(sizes: np.ndarray, floor: int, shards: int) -> int:
    """The smallest capacity, at least ``floor``, for which greedy packing fits."""
    ends = np.cumsum(sizes)
    lo, hi = max(floor, -(-int(ends[-1]) // shards)), int(ends[-1])
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if _greedy(ends, mid, shards) else (mid + 1, hi)
    return lo


def _in_doubt(units: dict, shards: int) -> tuple[int, np.ndarray]:
    """The least capacity with units taken as atomic, and which unresolved units a cut may fall into."""
    sizes, ends = units["size"], np.cumsum(units["size"])
    total = int(ends[-1])
    low, high = max(int(units["largest"].max()), -(-total // shards)), _least(sizes, int(sizes.max()), shards)
    starts, doubt, at = ends - sizes, np.zeros(len(sizes), bool), 0
    for k in range(1, shards + 1):
        i = int(np.searchsorted(ends, at + low, "right"))
        at = int(ends[i - 1]) if i else 0
        doubt |= (ends > at) & (starts < min(total, k * high))
        if at >= total:
            break
    return high, doubt & (units["groups"] > 1)


def _even_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Unit indexes at which shards 1.. begin: as even as the capacity allows."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    n, latest, at = len(sizes), [len(sizes)], len(sizes)
    for _ in range(shards):
        at = int(np.searchsorted(ends, ends[at] - capacity, "left"))
        latest.append(at)
    cuts, at = [], 0
    for k in range(1, shards):
        target = ends[at] + (ends[n] - ends[at]) / (shards - k + 1)
        to = int(np.searchsorted(ends, target))
        if to > at and (to > n or target - ends[to - 1] < ends[min(to, n)] - target):
            to -= 1
        most = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        at = max(at, min(max(to, latest[shards - k]), most, n))
        cuts.append(at)
    return cuts


def capacity_and_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """From groups (key long, size long): the least capacity, and the least key of each shard after the first."""
    def level(frame: DataFrame, shift: int) -> dict:
        got = (
            frame.groupBy(F.shiftright("key", shift).alias("unit"))
            .agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("groups"), F.min("key").alias("low"))
            .toPandas()
        )
        return {c: got[c].to_numpy(np.int64) for c in ("unit", "size", "largest", "groups", "low")} | {"shift": np.full(len(got), shift)}

    units = level(groups, COARSE_SHIFT)
    if not len(units["size"]):
        return 0, []
    while True:
        units = {k: v[np.argsort(units["low"], kind="stable")] for k, v in units.items()}
        high, doubt = _in_doubt(units, shards)
        if not doubt.any():
            break
        parts = [{k: v[~doubt] for k, v in units.items()}]
        for shift in np.unique(units["shift"][doubt]):
            chosen = units["unit"][doubt & (units["shift"] == shift)].tolist()
            wanted = groups.sparkSession.createDataFrame([(int(x),) for x in chosen], "unit long")
            inside = groups.withColumn("unit", F.shiftright("key", int(shift))).join(F.broadcast(wanted), "unit", "left_semi")
            parts.append(level(inside, max(0, int(shift) - 8)))
        units = {k: np.concatenate([p[k] for p in parts]) for k in units}
    edges = [int(units["low"][c]) if c < len(units["low"]) else None for c in _even_cuts(units["size"], high, shards)]
    return high, edges


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(DEAL)).cast("int").alias("dealt"),
        ),
        "shard-rows",
    )
    groups = cut(base.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    _, edges = capacity_and_cuts(groups, shards)
    shard = F.lit(0)
    for edge in edges:
        if edge is not None:
            shard = shard + (F.col("key") >= F.lit(edge)).cast("int")
    placed = base.withColumn("shard", shard.cast("int"))
    counts = placed.groupBy("shard", "dealt").count().toPandas().sort_values(["shard", "dealt"])  # at most shards * DEAL rows
    counts["first"] = counts.groupby("shard")["count"].cumsum() - counts["count"]
    first = docs.sparkSession.createDataFrame(
        [tuple(map(int, x)) for x in counts[["shard", "dealt", "first"]].itertuples(index=False)], "shard int, dealt int, first long"
    )
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("shard", "dealt").orderBy("key", "doc_id")).cast("long")
    return (
        placed.join(F.broadcast(first), ["shard", "dealt"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + row - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
