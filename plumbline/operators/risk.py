"""Risk flags, suppression, verdicts, gates and fixes. Flags are rows, so scores are plain sums."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V
from ..functions.rules import CREDENTIAL_ROOTS
from ..functions.scoring import advisory_verdict, downgrade, score_verdict
from ..schema import CAPABILITY_ADDED_WEIGHT, HOOK_CHANGED_WEIGHT, HOOK_WEIGHT, PROVENANCE_WEIGHT, SIZE_WEIGHT, capability_dim

PACKAGE = ["ecosystem", "name", "version"]


def credential_reads(names: Column) -> Column:
    """The environment names that look like credentials."""
    def cred(n: Column) -> Column:
        out = F.lit(False)
        for root in CREDENTIAL_ROOTS:
            out = out | F.upper(n).startswith(root)
        return out

    return F.filter(names, cred)


def risk_flags(packages: DataFrame, key: list[str] = PACKAGE) -> DataFrame:
    """(key, code, weight) from fingerprints: capabilities array, n_hooks int, env_reads array, analyzed boolean."""
    seen = packages.where(F.col("analyzed") | (F.size("capabilities") > 0) | (F.col("n_hooks") > 0))
    caps = seen.select(*key, "n_hooks", "env_reads", F.explode(F.array_distinct("capabilities")).alias("capability")).join(F.broadcast(capability_dim(packages.sparkSession)), "capability")
    caps = caps.where("not (capability = 'install-hook-exec' and n_hooks > 0)").where((F.col("capability") != "env-read") | (F.size(credential_reads(F.col("env_reads"))) > 0))
    hooks = seen.where("n_hooks > 0").select(*key, F.explode(F.sequence(F.lit(1), "n_hooks"))).select(*key, F.lit("install-hook").alias("code"), F.lit(HOOK_WEIGHT).alias("weight"))
    return caps.select(*key, "code", "weight").unionByName(hooks)


def drift_flags(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key, code, weight) from fingerprints of two versions: prev_/next_ capabilities, hooks (map phase to hash), size, analyzed."""
    both = pairs.where("prev_analyzed and next_analyzed")
    caps = both.select(*key, F.explode(F.array_except("next_capabilities", "prev_capabilities")).alias("c"), F.size("next_hooks").alias("h")).where("not (c = 'install-hook-exec' and h > 0)")
    caps = caps.select(*key, F.lit("capability-added").alias("code"), F.lit(CAPABILITY_ADDED_WEIGHT).alias("weight"))
    hooks = both.select(*key, "prev_hooks", F.explode("next_hooks").alias("phase", "hash")).withColumn("old", F.try_element_at("prev_hooks", F.col("phase")))
    added = hooks.where("old is null").select(*key, F.lit("install-hook-added").alias("code"), F.lit(HOOK_WEIGHT).alias("weight"))
    changed = hooks.where("old <> '' and hash <> '' and old <> hash").select(*key, F.lit("install-hook-changed").alias("code"), F.lit(HOOK_CHANGED_WEIGHT).alias("weight"))
    size = both.where("prev_size <> 0 and next_size <> 0 and (next_size >= 2 * prev_size or next_size * 2 <= prev_size)").select(*key, F.lit("size-anomaly").alias("code"), F.lit(SIZE_WEIGHT).alias("weight"))
    return caps.unionByName(added).unionByName(changed).unionByName(size)


def provenance_flags(packages: DataFrame, key: list[str] = PACKAGE) -> DataFrame:
    """The flag of npm packages without an attestation."""
    return packages.where("ecosystem = 'npm' and provenance_status = 'missing'").select(*key, F.lit("provenance-missing").alias("code"), F.lit(PROVENANCE_WEIGHT).alias("weight"))


MOST_BROADCAST, SALTS = 10000, 64


def _rule_join(flags: DataFrame, rules: DataFrame) -> DataFrame:
    """Flags with the rules that fit: an equi-join by ecosystem and name, one for exact names and one for ``*``; ranges are compiled once a rule.

    Rules for any name are broadcast if they are few, and dealt over salts of their ecosystem otherwise.
    """
    compiled = rules.select(
        F.col("ecosystem").alias("r_eco"), F.col("name").alias("r_name"), F.col("capability").alias("r_cap"), "reason", "rule_ord", "version_range",
        V.compile_range(F.col("version_range")).alias("compiled"),
    )
    exact = flags.join(compiled, (F.col("ecosystem") == F.col("r_eco")) & (F.col("name") == F.col("r_name")))
    wild = compiled.where("r_name = '*'")
    few = len(wild.select("rule_ord").limit(MOST_BROADCAST + 1).collect()) <= MOST_BROADCAST
    if few:
        any_name = flags.join(F.broadcast(wild), F.col("ecosystem") == F.col("r_eco"))
    else:  # an ecosystem is a hot key: its flags are dealt over SALTS tasks, each with all of its rules
        salted = wild.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = flags.withColumn("f_salt", F.pmod(F.xxhash64(*PACKAGE), F.lit(SALTS)).cast("int"))
        any_name = dealt.join(salted, (F.col("ecosystem") == F.col("r_eco")) & (F.col("f_salt") == F.col("r_salt"))).drop("f_salt", "r_salt")
    found = exact.unionByName(any_name)
    version = F.when(F.col("version") != "", V.parse_version(F.col("version")))
    return found.where((F.col("version_range") == "") | V.matches(F.col("compiled"), version)).drop("compiled")


def apply_allowlist(flags: DataFrame, rules: DataFrame) -> DataFrame:
    """Flags with ``suppressed`` and ``suppress_by``: exact names before ``*``, then rule order; only capability codes match."""
    flags = flags.withColumn("fid", F.xxhash64(*PACKAGE, "code"))
    caps = capability_dim(flags.sparkSession).select(F.col("capability").alias("code")).distinct()
    capable = flags.select(*PACKAGE, "code", "fid").distinct().join(F.broadcast(caps), "code", "left_semi")
    found = _rule_join(capable, rules).where("r_cap is null or r_cap = code")
    best = found.groupBy("fid").agg(F.min_by("reason", F.struct((F.col("r_name") == "*").alias("wild"), "rule_ord")).alias("reason"))
    return flags.join(best, "fid", "left").withColumns({"suppressed": F.col("reason").isNotNull(), "suppress_by": F.concat(F.lit("allowlisted: "), "reason")}).drop("fid", "reason")


def match_all(packages: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule that fits a package, whatever its capability, with its rank (exact names first)."""
    found = _rule_join(packages, rules)
    rank = F.row_number().over(Window.partitionBy(*PACKAGE).orderBy((F.col("r_name") == "*").cast("int"), "rule_ord"))
    return found.withColumn("match_rank", rank).select(*PACKAGE, "rule_ord", "reason", "match_rank")


def scores(flags: DataFrame, key: list[str] = PACKAGE) -> DataFrame:
    """(key, score) of flags that are not suppressed, never below 0."""
    counted = F.when(F.col("suppressed"), 0).otherwise(F.col("weight")) if "suppressed" in flags.columns else F.col("weight")
    return flags.groupBy(*key).agg(F.greatest(F.sum(counted), F.lit(0)).cast("long").alias("score"))


# Flags of the install phase, which unused packages keep.
INSTALL_CODES = ("install-hook", "install-hook-exec", "install-hook-suspicious", "install-hook-added")


def downgrade_unused(flags: DataFrame, reach: Column) -> DataFrame:
    """Suppress all but install-phase flags of packages that are not used."""
    off = (reach == "unused") & ~F.col("code").isin(*INSTALL_CODES)
    return flags.withColumn("suppressed", F.coalesce(F.col("suppressed") | off, F.lit(False)) if "suppressed" in flags.columns else F.coalesce(off, F.lit(False)))


def ci_verdicts(deps: DataFrame) -> DataFrame:
    """Verdict rank from ``score`` and ``severity`` (nulls: 0) and ``reachability``: the worse of both, advisories one level lower if unused."""
    adv = advisory_verdict(F.coalesce("severity", F.lit(0)))
    adv = F.when(F.col("reachability") == "unused", downgrade(adv)).otherwise(adv)
    return deps.withColumn("verdict", F.greatest(score_verdict(F.coalesce("score", F.lit(0))), adv))


def gate(rows: DataFrame, fail_on: int = 3, allow_unchecked: bool = False) -> DataFrame:
    """``action``: verified rows block at ``fail_on``; unverified ones block unless allowed or the parse was uncertain."""
    soft = F.lit(allow_unchecked) | F.coalesce("uncertain_parse", F.lit(False))
    return rows.withColumn(
        "action",
        F.when(F.col("verified") & (F.col("verdict") >= fail_on), "block").when(F.col("verified"), "proceed").when(soft, "warn-unchecked").otherwise("block-unchecked"),
    )


def fix_plan(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """(dependency, target_version, n_resolved, n_unresolved): the highest fix above the installed version."""
    hit = deps.join(advisories.select("ecosystem", "name", "id", F.coalesce("fixed_in", F.lit("")).alias("fixed_in")), ["ecosystem", "name"])
    forward = (F.col("fixed_in") != "") & V.newer(F.col("fixed_in"), F.col("version"))
    rank = F.struct(V.parse_version(F.col("fixed_in")).alias("v"), V.segments(F.col("fixed_in")).alias("s"))
    return hit.withColumn("forward", forward).groupBy(*PACKAGE).agg(
        F.max_by(F.when(F.col("forward"), F.col("fixed_in")), F.when(F.col("forward"), rank)).alias("target_version"),
        F.count_if("forward").alias("n_resolved"), F.count_if(~F.col("forward")).alias("n_unresolved"),
    )


# Upgrade commands by ecosystem, to a version and to the newest one.
UPGRADES = {
    "npm": ("npm install {name}@{version}", "npm install {name}@latest"),
    "pypi": ("pip install {name}=={version}", "pip install --upgrade {name}"),
    "rubygems": ("bundle update --conservative {name}  # target: {version}", "bundle update {name}"),
    "crates": ("cargo update -p {crate} --precise {version}", "cargo update -p {crate}"),
    "go": ("go get {name}@{version}", "go get {name}@latest"),
    "maven": ("mvn versions:set-property -Dproperty={artifact}.version -DnewVersion={version}", "mvn versions:use-latest-versions -Dincludes={group}:{artifact}"),
    "packagist": ("composer require {name}:{version}", "composer update {name}"),
    "nuget": ("dotnet add package {name} --version {version}", "dotnet add package {name}"),
    "pub": ("dart pub upgrade {name}  # target: {version} (pin in pubspec.yaml)", "dart pub upgrade {name}"),
    "cocoapods": ("pod update {name}  # target: {version} (pin in Podfile)", "pod update {name}"),
    "cpan": ("cpanm {name}@{version}", "cpanm {name}"),
    "hackage": ('cabal install --constraint="{name} =={version}"', "cabal install {name}"),
    "cran": ("R -e 'remotes::install_version(\"{name}\", \"{version}\")'", "R -e 'install.packages(\"{name}\")'"),
    "hex": ("# upgrade {name} to {version}: `mix deps.update {name}` (Elixir) or `gleam update {name}` (Gleam)", "# upgrade {name}: `mix deps.update {name}` (Elixir) or `gleam update {name}` (Gleam)"),
}


def _filled(form: str, parts: dict[str, Column]) -> Column:
    """A form with columns in place of its braces."""
    return F.concat(*[x for text, field, *_ in Formatter().parse(form) for x in ([F.lit(text)] if text else []) + ([parts[field]] if field else [])])


def upgrade_command(ecosystem: Column, name: Column, version: Column) -> Column:
    """The command that installs a version, or the newest where it is empty; null for other ecosystems, for Maven names
    without a group, and for names or versions with characters that a shell could read."""
    safe = name.rlike(r"\A[A-Za-z0-9._+/@:~-]{1,256}\z") & version.rlike(r"\A[A-Za-z0-9.+_-]{0,128}\z")
    group = F.regexp_extract(name, r"\A([^:]*):", 1)
    parts = {"name": name, "version": version, "crate": F.replace(name, F.lit("/"), F.lit("-")), "group": group, "artifact": F.regexp_extract(name, r"\A[^:]*:(.*)\z", 1)}
    out = F.lit(None).cast("string")
    for eco, (pinned, newest) in UPGRADES.items():
        fits = (ecosystem == eco) & (F.contains(name, F.lit(":")) if eco == "maven" else F.lit(True))
        out = F.when(fits, F.when(version == "", _filled(newest, parts)).otherwise(_filled(pinned, parts))).otherwise(out)
    return F.when(safe, out)


def denied_licenses(packages: DataFrame, denied: list[str]) -> DataFrame:
    """Packages whose whole license expression equals a denied one, whatever its case."""
    return packages.where(F.lower("license").isin(*[d.lower() for d in denied]))


def fleet(checks: DataFrame) -> DataFrame:
    """One row a task from check rows (task, check, failed): failed checks, and whether the task failed (unused dependencies are only reported)."""
    return checks.groupBy("task").agg(
        F.count_if("failed").alias("n_findings"), F.max(F.when(F.col("check") != "unused-deps", F.col("failed")).otherwise(False)).alias("task_failed"),
    )
