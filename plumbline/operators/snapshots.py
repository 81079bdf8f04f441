"""Snapshots: differences and rescans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import versions as V
from ..functions.scoring import advisory_verdict, downgrade, score_verdict
from ..functions.versions import is_patch_step
from ..schema import CAPABILITIES, CAPABILITY_ADDED_WEIGHT, HOOK_CHANGED_WEIGHT, HOOK_WEIGHT, PROVENANCE_WEIGHT, SIZE_WEIGHT
from ..shared import write_table
from .risk import MOST_BROADCAST, PACKAGE, apply_allowlist, credential_reads, scores

KEY = ["ecosystem", "name"]


def latest(snapshot: DataFrame, order: str) -> DataFrame:
    """One row a package: the last in order, as an index over duplicates keeps."""
    rest = [c for c in snapshot.columns if c not in (*KEY, order)]
    return snapshot.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*KEY, "r.*")  # combined before the shuffle


def diff(prev: DataFrame, nxt: DataFrame, order: str) -> DataFrame:
    """(ecosystem, name, kind, old_version, new_version): added, removed, upgraded."""
    old = latest(prev, order).select(*KEY, F.col("version").alias("old_version"))
    new = latest(nxt, order).select(*KEY, F.col("version").alias("new_version"))
    both = old.join(new, KEY, "full_outer")
    kind = F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "removed").when(F.col("old_version") != F.col("new_version"), "upgraded")
    return both.withColumn("kind", kind).where("kind is not null")


def rescan(known: DataFrame, found: DataFrame) -> DataFrame:
    """Advisory ids (ecosystem, name, id) that an earlier scan did not have."""
    return found.select(*KEY, "id").distinct().join(known.select(*KEY, "id"), [*KEY, "id"], "left_anti")


def to_enrich(snapshot: DataFrame) -> DataFrame:
    """Rows never looked up: a null (not an empty) fingerprint or advisory list."""
    return snapshot.where("fingerprint is null or advisories is null")


ENRICHED = ["fingerprint", "advisories", "reachability", "license", "deprecated", "provenance_status"]


def carry_forward(saved: DataFrame, live: DataFrame, order: str, enriched: list[str] | None = None) -> DataFrame:
    """``live`` rows (ecosystem, name, version and more) with what ``saved`` knows of the same version, and ``carried``.

    A package's version is looked up as a whole: what was not known there (null) stays to be enriched, as does every version
    that is new. Of repeated saved rows the first in ``order`` counts; repeated live rows stay.
    """
    enriched = ENRICHED if enriched is None else enriched
    known = saved.groupBy(*KEY, "version").agg(F.min_by(F.struct(*enriched), order).alias("known"))
    rest = [c for c in live.columns if c not in enriched]
    return live.select(*rest).join(known, [*KEY, "version"], "left").select(*rest, *[F.col(f"known.{c}").alias(c) for c in enriched], F.col("known").isNotNull().alias("carried"))


def maintain(saved: DataFrame, live: DataFrame, enrich: Callable[[DataFrame], DataFrame], order: str, enriched: list[str] | None = None) -> DataFrame:
    """The next snapshot: ``enrich`` (package columns to package columns and the enriched ones) sees each version once, and only
    those that ``saved`` has no fingerprint or advisories of; all others are carried over. ``scanned`` tells which it saw."""
    enriched = ENRICHED if enriched is None else enriched
    carried, _ = write_table(carry_forward(saved, live, order, enriched), "carried")
    known = F.lit(True)
    for c in [c for c in ("fingerprint", "advisories") if c in enriched]:
        known = known & F.col(c).isNotNull()
    todo, _ = write_table(carried.where(~known).select(*KEY, "version").distinct(), "to-enrich")
    fresh = enrich(todo).select(*KEY, "version", F.struct(*enriched).alias("fresh"))
    rows = carried.join(todo.withColumn("scanned", F.lit(True)), [*KEY, "version"], "left").join(fresh, [*KEY, "version"], "left")
    rest = [c for c in carried.columns if c not in (*enriched, "carried")]
    return rows.select(*rest, *[F.coalesce(F.col(f"fresh.{c}"), F.col(c)).alias(c) for c in enriched], F.coalesce("scanned", F.lit(False)).alias("scanned"))


SCHEMA_VERSION = 1


def save(snapshot: DataFrame, path: str, project: str, created_at: str) -> None:
    """Write a snapshot beside earlier ones: rows first, then, once they are committed, its header; without that it is not there."""
    folder = f"{path.rstrip('/')}/{created_at.replace(':', '')}"
    snapshot.write.mode("overwrite").parquet(f"{folder}/rows")
    header = [(SCHEMA_VERSION, project, created_at, snapshot.sparkSession.read.parquet(f"{folder}/rows").count())]
    snapshot.sparkSession.createDataFrame(header, "schema_version int, project string, created_at string, deps long").coalesce(1).write.mode("overwrite").json(f"{folder}/header")


def saved_headers(spark: SparkSession, path: str) -> DataFrame:
    """(folder, schema_version, project, created_at, deps, loadable): complete snapshots; other schemas cannot be loaded."""
    schema = "schema_version int, project string, created_at string, deps long"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = [str(x.getPath().getParent().getParent().toString()) for x in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "*/header/_SUCCESS")) or []] if files.exists(at) else []
    if not marks:
        return spark.createDataFrame([], f"folder string, {schema}, loadable boolean")
    rows = spark.read.schema(schema).json([f"{m}/header" for m in marks])
    folder = F.regexp_replace(F.input_file_name(), "/header/[^/]*$", "")
    return rows.select(folder.alias("folder"), *rows.columns, (F.col("schema_version") == SCHEMA_VERSION).alias("loadable"))


def load_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the newest complete snapshot, or None without one; one of another schema is an error."""
    found = saved_headers(spark, path).orderBy(F.desc("created_at")).first()
    if found is None:
        return None
    if not found.loadable:
        raise ValueError(f"snapshot {found.folder} has schema {found.schema_version}, not {SCHEMA_VERSION}: save it again")
    return spark.read.parquet(f"{found.folder}/rows")


def shown(snapshot: DataFrame, everything: bool = False) -> DataFrame:
    """Direct rows of each project; all rows if asked for or if a project has no direct one."""
    if everything:
        return snapshot
    any_direct = F.max(F.col("direct").cast("int")).over(Window.partitionBy("project"))
    return snapshot.withColumn("any", any_direct).where("direct or any = 0").drop("any")


def _flag(code: str, weight: int):
    return F.struct(F.lit(code).alias("code"), F.lit(weight).alias("weight"))


def _when(condition, flag):
    return F.when(condition, F.array(flag)).otherwise(F.array().cast("array<struct<code:string,weight:int>>"))


def _risk_array():
    """Flags of a row's next fingerprint, its attestation and its step from the previous one."""
    weights = F.create_map(*[F.lit(x) for c, w in CAPABILITIES for x in (c, w)])
    seen = F.col("analyzed") | (F.size("capabilities") > 0) | (F.col("n_hooks") > 0)
    counts = lambda c: F.map_contains_key(weights, c) & ~((c == "install-hook-exec") & (F.col("n_hooks") > 0)) & ((c != "env-read") | (F.size(credential_reads(F.col("env_reads"))) > 0))
    caps = F.transform(F.filter(F.array_distinct(F.array_compact("capabilities")), counts), lambda c: F.struct(c.alias("code"), F.element_at(weights, c).alias("weight")))
    hooks = F.array_repeat(_flag("install-hook", HOOK_WEIGHT), F.greatest(F.coalesce("n_hooks", F.lit(0)), F.lit(0)))
    missing = (F.col("ecosystem") == "npm") & (F.col("provenance_status") == "missing")
    gained = F.col("changed") & is_patch_step(F.col("old_version"), F.col("version")) & (F.size(F.array_except("capabilities", "prev_capabilities")) > 0)
    none = F.array().cast("array<struct<code:string,weight:int>>")
    return F.concat(
        F.coalesce(F.when(seen, F.concat(caps, hooks)), none), _when(missing, _flag("provenance-missing", PROVENANCE_WEIGHT)),
        _when(gained, _flag("patch-version-drift", dict(CAPABILITIES)["patch-version-drift"])),
    )


def _drift_score():
    """The sum of what changed since the previous fingerprint."""
    has_hooks = F.size("hooks") > 0
    caps = F.size(F.filter(F.array_except("capabilities", "prev_capabilities"), lambda c: ~((c == "install-hook-exec") & has_hooks)))
    old = lambda phase: F.try_element_at("prev_hooks", phase)
    added = F.size(F.map_filter("hooks", lambda phase, _: old(phase).isNull()))
    changed = F.size(F.map_filter("hooks", lambda phase, now: (old(phase) != "") & (now != "") & (old(phase) != now)))
    odd = (F.col("prev_size") != 0) & (F.col("size") != 0) & ((F.col("size") >= 2 * F.col("prev_size")) | (F.col("size") * 2 <= F.col("prev_size")))
    parts = [(caps, CAPABILITY_ADDED_WEIGHT), (added, HOOK_WEIGHT), (changed, HOOK_CHANGED_WEIGHT), (odd.cast("int"), SIZE_WEIGHT)]
    total = sum((F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) * w for n, w in parts), F.lit(0))
    return F.when(F.col("changed"), total).otherwise(0).cast("long")


def _risk_scores(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with ``flags``) and ``risk_score``: the flags that no rule allows.

    Rules meet a row as two arrays, those of its name and those for any name of its ecosystem, and are tried within the row.
    Where rules for any name are too many for that, flags are rows and rules are joined to them.
    """
    compiled = rules.select("ecosystem", F.col("name").alias("of"), F.struct(F.col("capability").alias("capability"), "version_range", V.compile_range(F.col("version_range")).alias("compiled")).alias("rule"))
    wild = compiled.where("of = '*'")
    if len(wild.limit(MOST_BROADCAST + 1).select("of").collect()) > MOST_BROADCAST:
        flags = rows.select(*PACKAGE, F.inline("flags"))
        found = scores(apply_allowlist(flags, rules), KEY).withColumnRenamed("score", "risk_score")
        return rows.join(found, KEY, "left").na.fill(0, ["risk_score"])
    named = compiled.where("of <> '*'").groupBy("ecosystem", F.col("of").alias("name")).agg(F.collect_list("rule").alias("named"))
    every = F.broadcast(wild.groupBy("ecosystem").agg(F.collect_list("rule").alias("wild")))  # MOST_BROADCAST rules at most
    met = rows.join(named, KEY, "left").join(every, "ecosystem", "left")
    version = F.when(F.col("version") != "", V.parse_version(F.col("version")))
    fits = lambda r: (r["version_range"] == "") | V.matches(r["compiled"], version)
    fitting = [F.filter(F.coalesce(F.col(c), F.array().cast(met.schema[c].dataType)), fits) for c in ("named", "wild")]
    allowed = F.concat(*[F.transform(x, lambda r: F.coalesce(r["capability"], F.lit("*"))) for x in fitting])
    codes = F.array(*[F.lit(c) for c, _ in CAPABILITIES])
    met = met.withColumn("allowed", allowed)
    counts = lambda f: ~(F.array_contains(codes, f["code"]) & (F.array_contains("allowed", "*") | F.array_contains("allowed", f["code"])))
    score = F.aggregate(F.filter("flags", counts), F.lit(0).cast("long"), lambda total, f: total + f["weight"])
    return met.withColumn("risk_score", F.greatest(score, F.lit(0).cast("long"))).drop("named", "wild", "allowed")


def score_diff(prev: DataFrame, nxt: DataFrame, rules: DataFrame, order: str) -> DataFrame:
    """(ecosystem, name, kind, old_version, new_version, risk_score, drift_score, verdict rank) of added and upgraded packages.

    Both snapshots have fingerprints: analyzed, capabilities, n_hooks, env_reads, hooks (map of phase to hash), size,
    provenance_status, reachability, and severity (the rank of the worst advisory, or null). Risk: the next fingerprint's
    flags, a missing attestation, and a patch step that gained a capability, less what the rules allow. Drift: what changed
    since the previous fingerprint; none for added packages. The verdict is the worst of the larger score and the advisories,
    these one level lower where the package is not used.

    A package is one row: each snapshot is shuffled once by name, both meet where they are, and flags are an array in the row.
    """
    old = latest(prev, order).select(*KEY, F.col("version").alias("old_version"), *[F.col(c).alias(f"prev_{c}") for c in ("analyzed", "capabilities", "hooks", "size")])
    kind = F.when(F.col("old_version").isNull(), "added").when(F.col("old_version") != F.col("version"), "upgraded")
    both = latest(nxt, order).join(old, KEY, "left").withColumn("kind", kind).where("kind is not null")
    both = both.withColumn("changed", F.coalesce((F.col("kind") == "upgraded") & F.col("prev_analyzed") & F.col("analyzed"), F.lit(False)))
    every = _risk_scores(both.withColumns({"flags": _risk_array(), "drift_score": _drift_score()}), rules)
    known = advisory_verdict(F.coalesce("severity", F.lit(0)))
    known = F.when(F.col("reachability") == "unused", downgrade(known)).otherwise(known)
    verdict = F.greatest(score_verdict(F.greatest("risk_score", "drift_score")), known)
    return every.select(*KEY, "kind", "old_version", F.col("version").alias("new_version"), "risk_score", "drift_score", verdict.alias("verdict"))
