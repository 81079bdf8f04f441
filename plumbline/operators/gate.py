"""The install gate over batches: advisories always looked up, scans only of what no trusted verdict is kept for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import advisory_verdict
from ..shared import write_table
from ..sources.versions_table import KeyedTable
from .risk import PACKAGE, gate

# The version of what a scan means, and how long a verdict is trusted.
SCAN_SCHEMA, KEEP_SECONDS = 2, 30 * 24 * 3600
UNRESOLVED = ("not-found", "no-match", "unreachable", "unsupported")


def rules_tag(rules: DataFrame) -> str:
    """A short digest of allow rules, empty without any: verdicts under one set of rules do not serve another."""
    n, total = rules.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(rules.columns)))).cast("decimal(38,0)"))).first()
    return f"{int(total) % (1 << 64):016x}" if n else ""


def verdict_cache(spark: SparkSession, path: str) -> KeyedTable:
    """Verdicts of scans by package, rules and scan version; a published version's code does not change, so they hold for a while."""
    return KeyedTable(spark, path, "ecosystem string, name string, version string, tag string, scan int, verdict int", [*PACKAGE, "tag", "scan"], KEEP_SECONDS)


def judge(
    requests: DataFrame, advisories: DataFrame, cache: KeyedTable, scan: Callable[[DataFrame], DataFrame], now: int, run: str, tag: str = "", deep: bool = False, fail_on: int = 3, allow_unchecked: bool = False,
) -> DataFrame:
    """One row a request, with verdict (rank), unchecked (why nothing could be said, or null), cached, action.

    ``requests``: request id columns of any kind, ecosystem, name, version (null if it could not be resolved), unresolved (why
    not, or null), kind (named or lockfile), private (registry). Named requests are scanned; those of lockfiles only with
    ``deep``, else their advisories alone count. ``advisories``: package columns, severity (rank), asked once for all.
    ``scan``: packages to (package columns, verdict rank or null, failed: why or null); it gets each package once, and only
    those without a kept verdict under the same rules (``tag``). Verdicts of scans that succeeded are kept for the next run;
    advisories never are. A scan that failed at a private registry warns, elsewhere it counts as unchecked.

    Writes the packages to scan and what was found before it returns. Null names or versions count as not found. Repeated
    requests get a row each and cost one scan.
    """
    unresolved = F.when(F.coalesce("name", F.lit("")) == "", "not-found").when(F.col("version").isNull(), F.coalesce("unresolved", F.lit("not-found"))).otherwise(F.col("unresolved"))
    asked = requests.withColumn("unresolved", unresolved)
    wants = F.col("unresolved").isNull() & (F.lit(deep) | (F.col("kind") == "named"))
    needed = asked.where(wants).select(*PACKAGE).distinct()
    mine = cache.rows(now).where((F.col("tag") == tag) & (F.col("scan") == SCAN_SCHEMA)).select(*PACKAGE, "verdict")
    kept, _ = write_table(needed.join(mine, PACKAGE).select(*PACKAGE, F.col("verdict").alias("scanned"), F.lit(None).cast("string").alias("failed"), F.lit(True).alias("cached")), "kept-verdicts")
    missing, _ = write_table(needed.join(kept, PACKAGE, "left_anti"), "to-scan")
    found = scan(missing).select(*PACKAGE, F.col("verdict").cast("int").alias("scanned"), F.col("failed").cast("string").alias("failed"))
    # what the scan says nothing about has failed as well
    found = missing.join(found, PACKAGE, "left").withColumn("failed", F.when(F.col("scanned").isNull(), F.coalesce("failed", F.lit("not-scanned"))).otherwise(F.col("failed")))
    found, _ = write_table(found.dropDuplicates(PACKAGE).withColumn("cached", F.lit(False)), "scanned")
    cache.put(found.where("failed is null").select(*PACKAGE, F.lit(tag).alias("tag"), F.lit(SCAN_SCHEMA).alias("scan"), F.col("scanned").alias("verdict")), run, now)
    worst = advisories.groupBy(*PACKAGE).agg(F.max("severity").alias("severity"))
    rows = asked.join(kept.unionByName(found), PACKAGE, "left").join(worst, PACKAGE, "left")
    why = F.coalesce("unresolved", F.when(wants, F.col("failed")))
    rows = rows.withColumns({"unchecked": why, "cached": F.coalesce(F.when(wants, F.col("cached")), F.lit(False))})
    verdict = F.greatest(F.coalesce(F.when(wants, F.col("scanned")), F.lit(0)), advisory_verdict(F.coalesce("severity", F.lit(0))))
    rows = rows.withColumns({"verified": F.col("unchecked").isNull(), "verdict": F.when(F.col("unchecked").isNull(), verdict), "uncertain_parse": F.lit(False)})
    soft = F.col("unresolved").isNull() & F.col("unchecked").isNotNull() & F.coalesce("private", F.lit(False))
    judged = gate(rows, fail_on, allow_unchecked)
    return judged.withColumn("action", F.when(soft, "warn-unchecked").otherwise(F.col("action"))).drop("verified", "uncertain_parse", "scanned", "failed", "severity", "unresolved")
