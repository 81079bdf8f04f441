"""Manifests: npm package files and Go retractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import dep_source

# The sections of a manifest that hold dependencies, by group; scripts that run at install.
GROUPS = {"dependencies": "runtime", "devDependencies": "dev", "optionalDependencies": "optional", "peerDependencies": "peer"}
PHASES = ("preinstall", "install", "postinstall", "prepare")
_SCHEMA = "name string, version string, files array<string>, scripts map<string,string>, " + ", ".join(f"{g} map<string,string>" for g in GROUPS)


def _parsed(files: DataFrame) -> DataFrame:
    return files.where(F.regexp_extract("path", r"([^/\\]+)\z", 1) == "package.json").select("path", F.from_json("text", _SCHEMA).alias("d")).where("d is not null")


def npm_dependencies(files: DataFrame) -> DataFrame:
    """(path, package, dep_name, spec, dep_group, dep_source) of package.json files."""
    rows, out = _parsed(files), None
    for section, group in GROUPS.items():
        part = rows.select("path", F.col("d.name").alias("package"), F.explode(f"d.{section}").alias("dep_name", "spec")).withColumn("dep_group", F.lit(group))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("dep_source", dep_source(F.col("spec")))


def npm_hooks(files: DataFrame) -> DataFrame:
    """(path, package, phase, body) of scripts that run at install."""
    rows = _parsed(files).select("path", F.col("d.name").alias("package"), F.explode("d.scripts").alias("phase", "body"))
    return rows.where(F.col("phase").isin(*PHASES))


def npm_listed_files(files: DataFrame) -> DataFrame:
    """(path, package, listed) of the files field."""
    return _parsed(files).select("path", F.col("d.name").alias("package"), F.explode("d.files").alias("listed"))


def go_retractions(files: DataFrame) -> DataFrame:
    """(path, low, high) of retract directives: single versions, ranges, and blocks of them."""
    mod = files.where(F.regexp_extract("path", r"([^/\\]+)\z", 1) == "go.mod").select("path", F.regexp_replace("text", r"//[^\n]*", "").alias("text"))
    blocks = F.regexp_extract_all("text", F.lit(r"(?m)^\s*retract\s*\(([^)]*)\)"), F.lit(1))
    single = F.regexp_extract_all("text", F.lit(r"(?m)^\s*retract\s+([^(\s][^\n]*)$"), F.lit(1))
    entry = mod.select("path", F.explode(F.concat(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), single)).alias("e")).withColumn("e", F.trim("e")).where("e <> ''")
    low = F.regexp_extract("e", r"\A\[?\s*(v[^,\s\]]+)", 1)
    high = F.regexp_extract("e", r"\A\[\s*v[^,\s]+\s*,\s*(v[^\]\s]+)\s*\]", 1)
    return entry.select("path", low.alias("low"), F.coalesce(F.nullif(high, F.lit("")), low).alias("high")).where("low <> ''")


def npmrc_registries(files: DataFrame) -> DataFrame:
    """(path, scope, url) of registry lines in .npmrc files; scope '' is the default."""
    pin = r"\A\s*(?:(@[^:\s]+):)?registry\s*=\s*(\S+)\s*\z"
    rows = files.where(F.regexp_extract("path", r"([^/\\]+)\z", 1) == ".npmrc").select("path", F.explode(F.split("text", r"\r?\n")).alias("line")).where(F.col("line").rlike(pin))
    return rows.select("path", F.regexp_extract("line", pin, 1).alias("scope"), F.regexp_replace(F.regexp_extract("line", pin, 2), r"/+\z", "").alias("url"))


def npmrc_tokens(files: DataFrame) -> DataFrame:
    """(path, host) of registries for which a token is set; the tokens themselves are not read out."""
    pin = r"\A\s*//([^\s=]+?)/?:_authToken\s*=\s*\S"
    rows = files.where(F.regexp_extract("path", r"([^/\\]+)\z", 1) == ".npmrc").select("path", F.explode(F.split("text", r"\r?\n")).alias("line")).where(F.col("line").rlike(pin))
    return rows.select("path", F.regexp_extract("line", pin, 1).alias("host"))
