"""Advisory operators: merging feeds, severities, and exploit signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cvss_base_score, cvss_rank, severity_name, severity_rank

KEY = ["ecosystem", "name"]


def merge_by_id(*feeds: DataFrame) -> DataFrame:
    """Feeds in order; of equal (package, id) the first feed's row stays."""
    frames = [f.withColumn("feed", F.lit(i)) for i, f in enumerate(feeds)]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    rest = [c for c in feeds[0].columns if c not in (*KEY, "id")]
    first = F.min_by(F.struct(*rest), F.struct("feed", "source", "fixed_in"))  # combined before the shuffle
    return union.groupBy(*KEY, "id").agg(first.alias("r")).select(*KEY, "id", "r.*").select(*feeds[0].columns)


def merge_by_alias(feed: DataFrame, order: str = "position") -> DataFrame:
    """Rows of each package in order; one goes if its id or an alias was seen in a row that stayed. Declared as a fold over each package's rows."""
    row = F.struct(F.col(order).alias("o"), "id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    rows = feed.groupBy(*KEY).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        names = F.concat(F.array(r["id"]), r["aliases"])
        seen = F.arrays_overlap(acc["seen"], names)
        return F.when(seen, acc).otherwise(F.struct(F.concat(acc["seen"], names).alias("seen"), F.concat(acc["kept"], F.array(r["id"])).alias("kept")))

    empty = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("kept"))
    return rows.select(*KEY, F.explode(F.aggregate("rows", empty, step)["kept"]).alias("id"))


def cve_of(id_col: Column, aliases: Column) -> Column:
    """The id if it is a CVE, else the first alias that is one."""
    return F.when(id_col.startswith("CVE-"), id_col).otherwise(F.try_element_at(F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a.startswith("CVE-")), F.lit(1)))


def epss_enrich(advisories: DataFrame, epss: DataFrame, order: list[str]) -> DataFrame:
    """Scores on the first advisory, in the given order, that carries a CVE; others keep 0. Malformed scores are skipped."""
    scored = epss.select("cve", F.col("epss").try_cast("double").alias("epss"), F.col("percentile").try_cast("double").alias("epss_percentile")).where("epss is not null and epss_percentile is not null")
    named = advisories.withColumn("cve", cve_of(F.col("id"), F.col("aliases")))
    named = named.withColumn("rn", F.row_number().over(Window.partitionBy(F.coalesce("cve", F.concat(F.lit("-"), "id"))).orderBy(*order)))
    joined = named.join(scored, (named.cve == scored.cve) & (named.rn == 1), "left").drop(scored.cve)
    return joined.withColumns({"epss": F.coalesce("epss", F.lit(0.0)), "epss_percentile": F.coalesce("epss_percentile", F.lit(0.0))}).drop("rn", "cve")


def kev_enrich(advisories: DataFrame, kev: DataFrame) -> DataFrame:
    """in_kev: whether the id or an alias is in the catalog."""
    rows = advisories.withColumn("rid", F.xxhash64(*KEY, "id"))
    names = rows.select("rid", F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("cve"))
    known = names.join(kev.select("cve").distinct(), "cve", "left_semi").select("rid").distinct().withColumn("in_kev", F.lit(True))
    return rows.join(known, "rid", "left").withColumn("in_kev", F.coalesce("in_kev", F.lit(False))).drop("rid")


def max_severity(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """deps with ``severity`` (rank, 0 without advisories), ``n_advisories``; advisories are reduced before the join."""
    worst = advisories.groupBy(*KEY).agg(F.max(severity_rank(F.col("severity"))).alias("severity"), F.count(F.lit(1)).alias("n_advisories"))
    return deps.join(worst, KEY, "left").withColumns({"severity": F.coalesce("severity", F.lit(0)), "n_advisories": F.coalesce("n_advisories", F.lit(0))})


OSV = (
    "id string, aliases array<string>, summary string, details string, severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, "
    "affected array<struct<ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>,ecosystem_specific:struct<functions:array<string>>>>"
)


def parse_osv(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """Advisory rows from OSV JSON: summary, first fixed version, functions and severity."""
    d = documents.withColumn("d", F.from_json(json_col, OSV))
    join = lambda c, f: F.flatten(F.filter(F.transform(c, f), lambda x: x.isNotNull()))
    ranges = F.filter(join("d.affected", lambda a: a["ranges"]), lambda r: r["type"].isin("SEMVER", "ECOSYSTEM"))
    fixed = join(ranges, lambda r: F.transform(r["events"], lambda e: e["fixed"]))
    first_line = F.split_part(F.col("d.details"), F.lit("\n"), F.lit(1))
    vectors = F.transform("d.severity", lambda s: cvss_rank(cvss_base_score(s["score"])))
    rank = F.greatest(F.coalesce(F.array_max(vectors), F.lit(0)), severity_rank(F.coalesce("d.database_specific.severity", F.lit(""))))
    functions = F.array_distinct(join("d.affected", lambda a: a["ecosystem_specific"]["functions"]))
    return d.select(
        *[c for c in documents.columns if c != json_col], F.col("d.id").alias("id"), F.col("d.aliases").alias("aliases"),
        F.coalesce(F.nullif("d.summary", F.lit("")), F.nullif(first_line, F.lit("")), F.lit("(no summary provided)")).alias("summary"),
        F.coalesce(F.try_element_at(F.filter(fixed, lambda v: v.isNotNull() & (v != "")), F.lit(1)), F.lit("")).alias("fixed_in"),
        severity_name(rank).alias("severity"), F.coalesce(functions, F.array().cast("array<string>")).alias("functions"),
    )


def is_valid_osv_id(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9_.:-]{1,128}\z")
