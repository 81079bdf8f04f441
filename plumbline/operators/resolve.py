"""Resolving requests to versions, and candidates for source tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import versions as V


def is_exact(c: Column) -> Column:
    """A full version without range signs or wildcards; any x makes it a range."""
    return c.rlike(r"\A[vV=]?[0-9]+\.[0-9]+\.[0-9]+[^\s<>=^~|*xX,]*\z")


def _best(requests: DataFrame, versions: DataFrame, range_col: Column) -> DataFrame:
    """(name, request, resolved): the newest version in range; pre-releases only if the range names one."""
    asked = requests.withColumn("rng", range_col)
    compiled = asked.select("rng").distinct().withColumn("compiled", V.compile_range(F.col("rng")))  # once a range, not once a package
    asked = asked.join(compiled, "rng")
    known = versions.select("name", F.col("version").alias("candidate"), V.parse_version(F.col("version")).alias("v")).where("v is not null")
    hit = asked.join(known, "name").where((F.contains("rng", F.lit("-")) | (F.col("v.release") == 1)) & (F.col("rng").isin("", "*") | V.matches(F.col("compiled"), F.col("v"))))
    return hit.groupBy("name", "request").agg(F.max_by("candidate", "v").alias("resolved"))


def resolve_npm(requests: DataFrame, versions: DataFrame, tags: DataFrame) -> DataFrame:
    """Requests (name, request): a dist-tag wins, an empty request is latest, an exact version is itself, else the range."""
    asked = requests.withColumn("tag", F.when(F.col("request") == "", "latest").otherwise(F.col("request")))
    tagged = asked.join(tags.select("name", "tag", F.col("version").alias("tagged")), ["name", "tag"], "left")
    ranged = _best(requests.distinct(), versions, F.col("request"))
    return tagged.join(ranged, ["name", "request"], "left").select("name", "request", F.coalesce("tagged", "resolved").alias("resolved"))


def resolve_crates(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Bare requests are carets; yanked versions are no candidates."""
    text = F.when(F.col("request").rlike(r"\A[0-9]"), F.concat(F.lit("^"), "request")).otherwise(F.col("request"))
    return _best(requests.distinct(), versions.where("not coalesce(yanked, false)"), text)


def pypi_range(request: Column) -> Column:
    """A PEP 440 request in the range dialect: ``~=X.Y`` is ``>=X.Y <X+1``, ``==`` is ``=``, ``.*`` an x-range."""
    def part(p: Column) -> Column:
        major = F.regexp_extract(p, r"\A~=\s*([0-9]+)", 1)
        minor = F.regexp_extract(p, r"\A~=\s*[0-9]+(?:\.([0-9]+))?", 1)
        wide = F.concat(F.lit(">="), major, F.when(minor != "", F.concat(F.lit("."), minor)).otherwise(""), F.lit(" <"), (major.try_cast("int") + 1).cast("string"))
        star = F.regexp_replace(F.regexp_replace(p, r"\A==\s*", ""), r"\.\*\z", ".x")
        return F.when(major != "", wide).when(p.rlike(r"\A==.*\.\*\z"), star).when(p.startswith("=="), F.concat(F.lit("="), F.trim(F.substring(p, 3, 200)))).otherwise(F.regexp_replace(p, r"\s+", ""))

    return F.array_join(F.transform(F.filter(F.split(request, ","), lambda p: F.trim(p) != ""), lambda p: part(F.trim(p))), " ")


def resolve_pypi(requests: DataFrame, versions: DataFrame) -> DataFrame:
    return _best(requests.distinct(), versions, pypi_range(F.col("request")))


def tag_candidates(name: Column, version: Column) -> Column:
    """Tags that a release may have, likeliest first, distinct; scoped names also by their last part."""
    n, v = F.trim(name), F.trim(version)
    short = F.regexp_replace(n, r"\A@[^/]*/", "")
    forms = lambda x: [F.concat(x, F.lit("@"), v), F.concat(x, F.lit("-v"), v), F.concat(x, F.lit("-"), v)]
    named = F.when(n != "", F.array(*forms(n), *forms(short))).otherwise(F.array().cast("array<string>"))
    return F.when(v == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(F.concat(F.lit("v"), v), v), named)))
