"""Policies: built-in rules, layers, drift of patch releases, baselines, unused dependencies, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import versions as V
from ..schema import capability_dim

# Npm packages whose purpose is a capability.
BUILTIN = {
    "dynamic-eval": ["lodash", "underscore", "handlebars", "ejs"],
    "shell-spawn": ["webpack", "@babel/core", "esbuild", "rollup", "vite", "parcel", "nodemon"],
    "net-egress": ["node-fetch", "axios", "got", "undici"],
    "install-hook-exec": ["fsevents", "node-sass", "sharp", "better-sqlite3", "bcrypt"],
}
_RULE = "rule_ord int, ecosystem string, name string, version_range string, capability string, reason string"


def builtin_rules(spark: SparkSession) -> DataFrame:
    rows = [("npm", n, "", c, f"{n} is known for {c}") for c, names in BUILTIN.items() for n in names]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], _RULE)


def layered(*layers: DataFrame) -> DataFrame:
    """Rules of built-in, user and project layers in that order."""
    out = None
    for i, rules in enumerate(layers):
        part = rules.withColumn("rule_ord", F.lit(i * 1_000_000) + F.col("rule_ord"))
        out = part if out is None else out.unionByName(part)
    return out


def invalid_rules(rules: DataFrame) -> DataFrame:
    """Rules that make a set unusable: a range that does not parse, an unknown capability, no name."""
    known = capability_dim(rules.sparkSession).select(F.col("capability").alias("k")).distinct()
    checked = rules.join(F.broadcast(known), rules.capability == F.col("k"), "left")
    bad_range = (F.col("version_range") != "") & V.compile_range(F.col("version_range")).isNull()
    return checked.where(bad_range | (F.col("capability").isNotNull() & F.col("k").isNull()) | (F.coalesce("name", F.lit("")) == "")).drop("k")


def patch_drift(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key): releases that only step the patch number and gain a capability."""
    gained = F.size(F.array_except("next_capabilities", "prev_capabilities")) > 0
    return pairs.where(V.is_patch_step(F.col("old_version"), F.col("new_version")) & gained).select(*key)


def baseline_drift(baseline: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """(key, new_capabilities, hook_drift): packages that gained a capability or changed hooks since a baseline."""
    none = F.array().cast("array<string>")
    old = baseline.select(*key, F.col("capabilities").alias("old_caps"), F.col("hooks").alias("old_hooks"))
    both = now.join(old, key, "left").withColumn("new_capabilities", F.array_except("capabilities", F.coalesce("old_caps", none)))
    hooks = F.to_json("hooks") != F.coalesce(F.to_json("old_hooks"), F.lit("{}"))
    return both.withColumn("hook_drift", hooks).where((F.size("new_capabilities") > 0) | F.col("hook_drift")).select(*key, "new_capabilities", "hook_drift")


def unused_dependencies(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """Declared runtime dependencies (project, dep_name) that a project never imports (project, dep_key)."""
    runtime = declared.where("dep_group = 'runtime'").select("project", "dep_name").distinct()
    return runtime.join(imported.select("project", F.col("dep_key").alias("dep_name")).distinct(), ["project", "dep_name"], "left_anti")


def schema_problems(snapshots: DataFrame, version: int = 1) -> DataFrame:
    """Snapshots whose schema version is another."""
    return snapshots.where(~F.col("schema_version").eqNullSafe(F.lit(version)))


def explain(spark: SparkSession) -> DataFrame:
    """Capabilities and what they mean, by weight, heaviest first, then by name."""
    return capability_dim(spark).select("capability", "code", "weight", "description").orderBy(F.desc("weight"), "capability")


def explain_package(flags: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """Flags of packages with the first place that shows each: (key, code, weight, path, line)."""
    first = evidence.groupBy(*key, "capability").agg(F.min(F.struct("path", "line")).alias("at"))
    return flags.join(first, (flags.code == first.capability) & _same(flags, first, key), "left").select(*[flags[k] for k in key], "code", "weight", "at.path", "at.line")


def _same(a: DataFrame, b: DataFrame, key: list[str]):
    out = F.lit(True)
    for k in key:
        out = out & (a[k] == b[k])
    return out


def truncate(c, most: int = 160):
    """Evidence text: trimmed, at most so many characters, an ellipsis where it was cut."""
    t = F.trim(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)
