"""Fleet runs: several projects, each with the checks that it asks for, composed from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import dep_key
from ..functions.scoring import score_verdict, verdict_name
from .analysis import file_imports, fingerprints
from .risk import apply_allowlist, risk_flags, scores

VERSIONED = ["ecosystem", "name", "version"]
NODE = "js"


def _wants(tasks: DataFrame, *checks: str) -> DataFrame:
    asked = F.exists("checks", lambda c: c.isin(*checks))
    return tasks.where(asked)


def scanned(tasks: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """(task, verdict rank, score) of tasks that ask for ``ast`` or ``heuristics``: their own files as one package without a version."""
    mine = files.join(_wants(tasks, "ast", "heuristics").select("task", "ecosystem"), "task")
    packages = mine.select("ecosystem", F.col("task").cast("string").alias("name"), F.lit("").alias("version"), "path", "body")
    none = packages.select(*VERSIONED, F.lit("").alias("phase"), "body").limit(0)
    score = scores(apply_allowlist(risk_flags(fingerprints(packages, none)), rules), ["name"]).withColumnRenamed("score", "score")
    asked = _wants(tasks, "ast", "heuristics").select("task").withColumn("name", F.col("task").cast("string"))
    return asked.join(score, "name", "left").select("task", score_verdict(F.coalesce("score", F.lit(0))).alias("verdict"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def _counted(tasks: DataFrame, check: str, deps: DataFrame, facts: DataFrame, keys: list[str], rows: bool = False) -> DataFrame:
    """(task, n, worst): dependencies with a version for which ``facts`` holds a row; with ``rows`` all rows count."""
    mine = deps.where("version <> ''").select("task", *VERSIONED).distinct().join(_wants(tasks, check).select("task", F.transform(F.coalesce("deny_licenses", F.array().cast("array<string>")), F.lower).alias("denied")), "task")
    hit = mine.join(facts, keys)
    if check == "license":
        hit = hit.where(F.array_contains("denied", F.lower("license")))
    return hit.groupBy("task").agg((F.count(F.lit(1)) if rows else F.count_distinct(*VERSIONED)).alias("n"), F.max("severity" if rows else F.lit(0)).alias("worst"))


def unused(tasks: DataFrame, files: DataFrame, declared: DataFrame) -> DataFrame:
    """(task, unused): runtime dependencies (task, dep_name) of tasks that ask for it and are imported by none of its scripts."""
    mine = files.join(_wants(tasks, "unused-deps").select("task"), "task")
    seen = file_imports(mine, every=True).where(F.col("language") == NODE).select("task", dep_key(F.col("language"), F.col("key_of")).alias("dep_name")).distinct()
    left = declared.join(_wants(tasks, "unused-deps").select("task"), "task").select("task", "dep_name").distinct().join(seen, ["task", "dep_name"], "left_anti")
    return left.groupBy("task").agg(F.array_sort(F.collect_list("dep_name")).alias("unused"))  # as many as a manifest names


def run(tasks: DataFrame, files: DataFrame, deps: DataFrame, advisories: DataFrame, health: DataFrame, licenses: DataFrame, declared: DataFrame, rules: DataFrame, high: int = 3) -> DataFrame:
    """One row a task (task, ecosystem, checks array, deny_licenses array): verdict, score, findings, unused, failed.

    ``files`` (task, path, body), ``deps`` (task, ecosystem, name, version) of its lockfiles, ``advisories`` (ecosystem, name,
    version, id, severity rank), ``health`` (ecosystem, name, version, deprecated), ``licenses`` (ecosystem, name, version,
    license), ``declared`` (task, dep_name). A task fails on a blocking scan, an advisory of rank ``high`` or worse, a
    deprecated dependency or a denied license; unused dependencies are only told.
    """
    found = tasks.select("task").join(scanned(tasks, files, rules), "task", "left")
    cve = _counted(tasks, "cve", deps, advisories.select(*VERSIONED, "id", "severity").distinct(), VERSIONED, rows=True).select("task", F.col("n").alias("cve_findings"), "worst")
    old = _counted(tasks, "deprecated", deps, health.where("deprecated").select(*VERSIONED).distinct(), VERSIONED).select("task", F.col("n").alias("deprecated_findings"))
    bad = _counted(tasks, "license", deps, licenses.select(*VERSIONED, "license").distinct(), VERSIONED).select("task", F.col("n").alias("license_findings"))
    every = found.join(cve, "task", "left").join(old, "task", "left").join(bad, "task", "left").join(unused(tasks, files, declared), "task", "left")
    every = every.na.fill(0, ["cve_findings", "deprecated_findings", "license_findings", "worst", "score"])
    failed = (F.coalesce("verdict", F.lit(0)) >= 3) | (F.col("worst") >= high) | (F.col("deprecated_findings") > 0) | (F.col("license_findings") > 0)
    return every.select(
        "task", F.when(F.col("verdict").isNotNull(), verdict_name(F.col("verdict"))).alias("verdict"), "score", "cve_findings", "deprecated_findings", "license_findings",
        F.coalesce("unused", F.array().cast("array<string>")).alias("unused"), failed.alias("failed"),
    )
