"""Feeds as tables: advisory queries, GitHub advisories, exploit scores, registry documents, provenance, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ecosystem_dim


def osv_name(ecosystem: Column, name: Column) -> Column:
    """A package's name in the OSV feed: Swift URLs lose their scheme and ``.git``."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.git\z", ""), r"\Ahttps?://", "")
    return F.when(ecosystem == "swifturl", bare).otherwise(name)


def advisory_queries(deps: DataFrame) -> DataFrame:
    """(ecosystem, name, version, osv, osv_name) to look up: versions known and ecosystems that the feed has, distinct."""
    dims = ecosystem_dim(deps.sparkSession).where("osv is not null").select("ecosystem", "osv")
    rows = deps.where(F.coalesce("version", F.lit("")) != "").select("ecosystem", "name", "version").distinct()
    return rows.join(F.broadcast(dims), "ecosystem").withColumn("osv_name", osv_name(F.col("ecosystem"), F.col("name")))


def looked_up(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(ecosystem, name, version, advisories): every query has a row; none found is an empty list, never null."""
    ids = hits.groupBy("ecosystem", "name", "version").agg(F.array_sort(F.collect_set("id")).alias("advisories"))
    return queries.select("ecosystem", "name", "version").join(ids, ["ecosystem", "name", "version"], "left").withColumn("advisories", F.coalesce("advisories", F.array().cast("array<string>")))


def with_stubs(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (.., id) with their documents; one that could not be fetched is an info stub."""
    known = hits.join(documents, "id", "left")
    return known.withColumns({"severity": F.coalesce("severity", F.lit("info")), "summary": F.coalesce("summary", F.lit("(details unavailable)"))})


_GHSA = "data struct<securityVulnerabilities:struct<nodes:array<struct<advisory:struct<ghsaId:string,summary:string,severity:string,identifiers:array<struct<type:string,value:string>>>,package:struct<name:string,ecosystem:string>,firstPatchedVersion:struct<identifier:string>>>>>"


def parse_ghsa(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """Advisory rows of GitHub responses: CVE identifiers become aliases, the first patched version the fix; nodes without an id go."""
    names = ecosystem_dim(documents.sparkSession).select("ecosystem", F.col("ghsa").alias("g")).where("g is not null")
    nodes = documents.select(F.explode(F.from_json(json_col, _GHSA)["data"]["securityVulnerabilities"]["nodes"]).alias("n")).where("coalesce(n.advisory.ghsaId, '') <> ''")
    cves = F.transform(F.filter("n.advisory.identifiers", lambda i: i["type"] == "CVE"), lambda i: i["value"])
    rows = nodes.select(
        F.col("n.package.ecosystem").alias("g"), F.col("n.package.name").alias("name"), F.col("n.advisory.ghsaId").alias("id"), F.coalesce(cves, F.array().cast("array<string>")).alias("aliases"),
        F.lower("n.advisory.severity").alias("severity"), F.col("n.advisory.summary").alias("summary"), F.coalesce("n.firstPatchedVersion.identifier", F.lit("")).alias("fixed_in"), F.lit("ghsa").alias("source"),
    )
    return rows.join(F.broadcast(names), "g").drop("g")


def attach_all_versions(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Each advisory of a package at every pinned version of it: this feed's ranges are not applied."""
    return deps.select("ecosystem", "name", "version").distinct().join(advisories, ["ecosystem", "name"])


def parse_epss(documents: DataFrame, json_col: str = "json") -> DataFrame:
    rows = documents.select(F.explode(F.from_json(json_col, "data array<struct<cve:string,epss:string,percentile:string>>")["data"]).alias("d")).select("d.*")
    typed = rows.select("cve", F.col("epss").try_cast("double").alias("epss"), F.col("percentile").try_cast("double").alias("percentile"))
    return typed.where("epss is not null and percentile is not null")


def parse_kev(documents: DataFrame, json_col: str = "json") -> DataFrame:
    return documents.select(F.explode(F.from_json(json_col, "vulnerabilities array<struct<cveID:string>>")["vulnerabilities"]).alias("v")).select(F.col("v.cveID").alias("cve")).where("cve <> ''").distinct()


def license_of(doc: Column) -> Column:
    """The licence of an npm document: text, an object's type, or a list of objects joined with OR; null without one."""
    v = F.try_parse_json(doc)
    plain = F.try_variant_get(v, "$.license", "string")
    typed = F.try_variant_get(v, "$.license.type", "string")
    many = F.transform(F.from_json(doc, "licenses array<struct<type:string>>")["licenses"], lambda x: x["type"])
    joined = F.nullif(F.array_join(F.array_compact(many), " OR "), F.lit(""))
    return F.coalesce(typed, F.when(~plain.startswith("{"), F.nullif(plain, F.lit(""))), joined)


def registry_license(doc: Column, ecosystem: Column) -> Column:
    """The licence that a registry's document of a version states, in the place where each of five registries has it; else null."""
    v = F.try_parse_json(doc)
    at = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))
    every = F.filter(F.try_variant_get(v, "$.licenses", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    gems = F.nullif(F.array_join(F.filter(F.transform(every, lambda x: F.try_variant_get(x, "$", "string")), lambda x: x != ""), " OR "), F.lit(""))
    return (
        F.when(ecosystem == "npm", license_of(doc)).when(ecosystem == "pypi", at("$.info.license")).when(ecosystem == "crates", at("$.version.license"))
        .when(ecosystem == "rubygems", gems).when(ecosystem == "nuget", F.coalesce(at("$.catalogEntry.licenseExpression"), at("$.catalogEntry.licenseUrl")))
    )


def provenance(attestations: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Rows with ``source_uri`` and ``commit`` of a base64 SLSA statement's build definition; nulls where there is none."""
    schema = "predicate struct<buildDefinition:struct<resolvedDependencies:array<struct<uri:string,digest:struct<gitCommit:string>>>>>"
    text = F.try_to_binary(F.col(payload_col), F.lit("base64")).cast("string")
    dep = F.try_element_at(F.from_json(text, schema)["predicate"]["buildDefinition"]["resolvedDependencies"], F.lit(1))
    return attestations.withColumns({"source_uri": F.regexp_replace(F.regexp_replace(dep["uri"], r"\Agit\+", ""), r"@refs/.*\z", ""), "commit": dep["digest"]["gitCommit"]})


# Ecosystems that the health service knows.
HEALTH = ("npm", "pypi", "crates", "go", "maven", "nuget")


def health(deps: DataFrame, facts: DataFrame) -> DataFrame:
    """deps with a health table's columns where the ecosystem is served; nulls elsewhere."""
    served = facts.where(F.col("ecosystem").isin(*HEALTH))
    return deps.join(served, ["ecosystem", "name", "version"], "left")


def fresh(cache: DataFrame, now: Column, seconds: int, at: str = "fetched_at") -> DataFrame:
    """Cached rows no older than a time to live."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp(F.col(at)) <= seconds)


def packument_releases(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """(name, version, published_at, publisher, unpublished) of npm documents: a time without a version was unpublished."""
    schema = "name string, time map<string,string>, versions map<string,struct<_npmUser:struct<name:string>>>"
    d = documents.select(F.from_json(json_col, schema).alias("d")).select("d.*")
    each = d.select("name", "versions", F.explode("time").alias("version", "published")).where("version not in ('created', 'modified')")
    entry = F.try_element_at("versions", F.col("version"))
    return each.select("name", "version", F.try_to_timestamp("published").alias("published_at"), F.coalesce(entry["_npmUser"]["name"], F.lit("")).alias("publisher"), entry.isNull().alias("unpublished"))


def imposed_registry(specs: DataFrame, registries: DataFrame) -> DataFrame:
    """specs (name) with the registry of their scope, else the default (scope ''), else the public one."""
    scoped = registries.where("scope <> ''").select(F.col("scope").alias("s"), F.col("url").alias("scoped"))
    default = registries.where("scope = ''").select(F.col("url").alias("default_url")).limit(1)
    rows = specs.withColumn("s", F.regexp_extract("name", r"\A(@[^/]+)/", 1)).join(scoped, "s", "left").join(F.broadcast(default), F.lit(True), "left")
    return rows.withColumn("registry", F.coalesce("scoped", "default_url", F.lit("https://registry.npmjs.org"))).drop("s", "scoped", "default_url")
