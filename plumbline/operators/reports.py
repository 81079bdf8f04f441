"""Report projections: CycloneDX, SPDX, SARIF, gate JSON. Times and serial numbers are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import purl, url_component
from ..functions.scoring import severity_name, verdict_name


# Names of hash algorithms by the prefix of an integrity field.
HASHES = {"sha512": "SHA-512", "sha384": "SHA-384", "sha256": "SHA-256", "sha1": "SHA-1"}
NOASSERTION = "NOASSERTION"


def integrity_hash(integrity: Column) -> Column:
    """struct(alg, content as hex) of an ``algorithm-base64`` integrity field of at most 512 bytes, or null."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in HASHES.items() for x in kv]), F.lower(F.regexp_extract(integrity, r"\A([^-]*)-", 1)))
    content = F.lower(F.hex(F.try_to_binary(F.regexp_extract(integrity, r"\A[^-]*-(.*)\z", 1), F.lit("base64"))))
    return F.when((F.octet_length(integrity) <= 512) & kind.isNotNull() & content.isNotNull(), F.struct(kind.alias("alg"), content.alias("content")))


def integrity_hex(integrity: Column) -> Column:
    """Hex of a ``sha512-<base64>`` integrity field, or null."""
    return F.when(integrity.startswith("sha512-"), integrity_hash(integrity)["content"])


def components(deps: DataFrame) -> DataFrame:
    """One CycloneDX component a dependency: purl, scope, hash."""
    hashed = integrity_hex(F.col("integrity")) if "integrity" in deps.columns else F.lit(None).cast("string")
    return deps.select(
        "ecosystem", "name", "version", purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"),
        F.when(F.col("direct"), "required").otherwise("optional").alias("scope"), hashed.alias("sha512"),
    )


def _optional(frame: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in frame.columns else F.lit(None).cast(kind)


def versioned_key() -> Column:
    return F.concat("ecosystem", F.lit("/"), "name", F.lit("@"), "version")


def _dealt(rows: DataFrame, project: str) -> DataFrame:
    """Rows by project, in all shuffle partitions: making documents costs far more than their bytes tell, so none are merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), project)


def _linked(parts: DataFrame, project: str, own: Column) -> DataFrame:
    """(project, ref, owns, children): per reference what ``own`` says of its rows, and its children, sorted.

    ``parts`` has project, ``key``, ``ref`` and ``needs`` (keys). Every row gives its key, and asks for those it needs; both
    meet in the project's own partition, so that parts which lie by project are not shuffled again.
    """
    none, word = F.lit(None).cast(parts.select(own.alias("own")).schema["own"].dataType), F.lit(None).cast("string")
    asker = F.struct(F.col("ref").alias("ref"))
    said = lambda key, ref, asks, own: F.struct(key.alias("key"), ref.alias("ref"), asks.alias("asks"), own.alias("own"))
    rows = parts.select(project, F.explode(F.concat(F.array(said(F.col("key"), F.col("ref"), F.lit(None).cast("struct<ref:string>"), own)), F.transform("needs", lambda k: said(k, word, asker, none)))).alias("x")).select(project, "x.*")
    met = rows.groupBy(project, "key").agg(F.collect_set("ref").alias("refs"), F.collect_set("asks").alias("asks"), F.collect_list(F.when(F.col("own").isNotNull(), F.struct("ref", "own"))).alias("owns"))
    told = lambda ref, child, own: F.struct(ref.alias("ref"), child.alias("child"), own.alias("own"))
    pairs = F.when(F.col("key").isNotNull(), F.flatten(F.transform("asks", lambda a: F.transform("refs", lambda r: told(a["ref"], r, none)))))
    rows = met.select(project, F.explode(F.concat(F.transform("owns", lambda o: told(o["ref"], word, o["own"])), F.coalesce(pairs, F.array()))).alias("x")).select(project, "x.*")
    return rows.groupBy(project, "ref").agg(F.collect_list("own").alias("owns"), F.array_sort(F.collect_set("child")).alias("children"))


def _keyed(deps: DataFrame) -> DataFrame:
    needs = F.coalesce(_optional(deps, "depends_on", "array<string>"), F.array().cast("array<string>"))
    return deps.withColumns({"key": versioned_key(), "ref": purl(F.col("ecosystem"), F.col("name"), F.col("version")), "needs": needs})


def dependency_nodes(deps: DataFrame, project: str) -> DataFrame:
    """(project, ref, children): every component's children among the project's own, from ``depends_on`` keys, sorted."""
    return _linked(_keyed(deps).select(project, "key", "ref", "needs").distinct(), project, F.lit(True)).select(project, "ref", "children")


def cyclonedx(deps: DataFrame, advisories: DataFrame, project: str, timestamp: str, serial: str, tool: str = "plumbline", tool_version: str = "") -> DataFrame:
    """(project, document): a CycloneDX 1.5 document for each project; components sorted by purl, vulnerabilities by component, then id.

    ``deps`` may have ``integrity``, ``license`` and ``depends_on``, ``advisories`` ``source``, ``url`` and ``summary``; what is
    unknown is left out. A document is one row; use ``components`` and ``dependency_nodes`` where tables are wanted.

    Dependencies meet their advisories by package and are then dealt by project, once: all lists of a document are made there.
    """
    source, url = (F.coalesce(_optional(advisories, c), F.lit("")) for c in ("source", "url"))
    vuln = F.struct(
        "id", F.when((source != "") | (url != ""), F.struct(source.alias("name"), url.alias("url"))).alias("source"), F.array(F.struct(F.lower("severity").alias("severity"))).alias("ratings"), _optional(advisories, "summary").alias("description"),
    )
    known = advisories.groupBy("ecosystem", "name").agg(F.collect_list(vuln).alias("known"))
    hashed, license_ = integrity_hash(_optional(deps, "integrity")), F.nullif(_optional(deps, "license"), F.lit(""))
    part = F.struct(
        F.col("ref").alias("bom-ref"), F.lit("library").alias("type"), "name", "version", F.col("ref").alias("purl"), F.when(F.col("direct"), "required").otherwise("optional").alias("scope"), F.when(hashed.isNotNull(), F.array(hashed)).alias("hashes"),
        F.when(license_.isNotNull(), F.array(F.struct(F.struct(license_.alias("id")).alias("license")))).alias("licenses"),
    )
    rows = _dealt(deps.join(known, ["ecosystem", "name"], "left"), project)
    package = F.struct("ecosystem", "name")
    own = F.struct(part.alias("part"), F.coalesce("direct", F.lit(False)).alias("direct"), package.alias("package"), "known")
    nodes = _linked(_keyed(rows), project, own)
    # advisories of a component count once, however many rows it has
    found = F.flatten(F.transform(F.array_distinct(F.transform("owns", lambda o: o["package"])), lambda p: F.coalesce(F.filter("owns", lambda o: o["package"].eqNullSafe(p))[0]["known"], F.array().cast(known.schema["known"].dataType))))
    affects = F.array(F.struct(F.col("ref").alias("ref")))
    hits = F.transform(found, lambda v: F.struct(F.col("ref").alias("purl"), v["id"].alias("id"), v["source"].alias("source"), v["ratings"].alias("ratings"), v["description"].alias("description"), affects.alias("affects")))
    nodes = nodes.select(project, "ref", "children", F.array_distinct(F.transform("owns", lambda o: o["part"])).alias("parts"), F.exists("owns", lambda o: o["direct"]).alias("direct"), hits.alias("hits"))
    listed = nodes.groupBy(project).agg(
        F.array_sort(F.flatten(F.collect_list("parts"))).alias("components"), F.array_sort(F.collect_list(F.when(F.col("direct"), F.col("ref")))).alias("direct"),
        F.array_sort(F.collect_list(F.struct("ref", F.col("children").alias("dependsOn")))).alias("nodes"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
    )
    vulns = F.when(F.size("hits") > 0, F.transform("hits", lambda v: v.dropFields("purl")))
    root = F.col(project).cast("string")
    doc = F.to_json(F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(serial).alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(F.lit(timestamp).alias("timestamp"), F.struct(F.array(F.struct(F.lit("application").alias("type"), F.lit(tool).alias("name"), F.lit(tool_version).alias("version"))).alias("components")).alias("tools"),
                 F.struct(F.lit("root").alias("bom-ref"), F.lit("application").alias("type"), root.alias("name")).alias("component")).alias("metadata"),
        "components", F.concat(F.array(F.struct(F.lit("root").alias("ref"), F.col("direct").alias("dependsOn"))), "nodes").alias("dependencies"), vulns.alias("vulnerabilities"),
    ))
    return listed.select(project, doc.alias("document"))


def spdx_id(c: Column) -> Column:
    return F.concat(F.lit("SPDXRef-Package-"), F.regexp_replace(c, r"[^A-Za-z0-9.-]", "-"))


def spdx(deps: DataFrame, project: str, created: str, advisories: DataFrame | None = None, namespace: str = "urn:sbom", tool: str = "plumbline") -> DataFrame:
    """(project, document): an SPDX 2.3 document for each project: its root, a package a dependency with its purl and its
    advisories as SECURITY references (by ``url``, else ``id``), and who depends on what."""
    own = purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    reference = lambda category, kind, at: F.struct(F.lit(category).alias("referenceCategory"), F.lit(kind).alias("referenceType"), at.alias("referenceLocator"))
    rows = deps.withColumns({"own": own, "license_id": F.coalesce(F.nullif(_optional(deps, "license"), F.lit("")), F.lit(NOASSERTION))})
    none = F.array().cast("array<struct<referenceCategory:string,referenceType:string,referenceLocator:string>>")
    if advisories is not None:
        at = F.coalesce(F.nullif(_optional(advisories, "url"), F.lit("")), F.col("id"))
        known = advisories.groupBy("ecosystem", "name").agg(F.transform(F.array_sort(F.collect_set(F.struct("id", at.alias("at")))), lambda a: reference("SECURITY", "advisory", a["at"])).alias("known"))
        rows = _dealt(rows.join(known, ["ecosystem", "name"], "left"), project)
    else:
        rows = rows.withColumn("known", none)
    pid = spdx_id(F.concat_ws("-", "ecosystem", "name", "version"))
    blank = F.lit(NOASSERTION)
    package = F.struct(
        pid.alias("SPDXID"), "name", F.col("version").alias("versionInfo"), blank.alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"), F.concat(F.array(reference("PACKAGE-MANAGER", "purl", F.col("own"))), F.coalesce("known", none)).alias("externalRefs"),
        F.col("license_id").alias("licenseConcluded"), F.col("license_id").alias("licenseDeclared"), blank.alias("copyrightText"),
    )
    root = spdx_id(F.col(project).cast("string"))
    relation = F.struct(root.alias("spdxElementId"), F.when(F.col("direct"), "DEPENDS_ON").otherwise("DYNAMIC_LINK").alias("relationshipType"), pid.alias("relatedSpdxElement"))
    gathered = rows.groupBy(project).agg(F.array_sort(F.collect_set(package)).alias("packages"), F.array_sort(F.collect_set(relation)).alias("relations"))
    top = F.struct(
        root.alias("SPDXID"), F.col(project).cast("string").alias("name"), blank.alias("versionInfo"), blank.alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"), none.alias("externalRefs"),
        blank.alias("licenseConcluded"), blank.alias("licenseDeclared"), blank.alias("copyrightText"),
    )
    describes = F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), root.alias("relatedSpdxElement"))
    doc = F.to_json(F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col(project).cast("string").alias("name"), F.concat(F.lit(namespace + "/"), url_component(F.col(project).cast("string"))).alias("documentNamespace"),
        F.struct(F.lit(created).alias("created"), F.array(F.lit(f"Tool: {tool}")).alias("creators")).alias("creationInfo"), F.concat(F.array(top), "packages").alias("packages"), F.concat(F.array(describes), "relations").alias("relationships"),
    ))
    return gathered.select(project, doc.alias("document"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF result rows of advisory findings (ecosystem, name, version, id, summary, severity rank)."""
    level = F.when(F.col("severity") >= 3, "error").when(F.col("severity") == 2, "warning").otherwise("note")
    return findings.select(
        F.lit("vulnerable-dependency").alias("ruleId"), level.alias("level"),
        F.concat(F.col("id"), F.lit(": "), F.col("summary"), F.lit(" ("), severity_name(F.col("severity")), F.lit(")")).alias("message"),
        F.concat(F.col("ecosystem"), F.lit("/"), F.col("name"), F.lit("@"), F.col("version")).alias("location"),
    )


def flag_level(weight: Column) -> Column:
    return F.when(weight >= 60, "error").when(weight >= 20, "warning").otherwise("note")


def sarif(results: DataFrame, tool: str, group: str) -> DataFrame:
    """(group, document): a SARIF 2.1.0 log for each group of result rows."""
    result = F.struct("ruleId", "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("location").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"))
    doc = F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.col("results"))).alias("runs")))
    return results.groupBy(group).agg(F.array_sort(F.collect_list(result)).alias("results")).select(group, doc.alias("document"))


def gate_report(verdicts: DataFrame, fail_on: int, by: list[str]) -> DataFrame:
    """Counts of verdicts by group, and whether the gate passes."""
    counts = [F.count_if(F.col("verdict") == i).alias(n) for i, n in enumerate(("safe", "review", "prompt", "blocked"))]
    return verdicts.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts, (F.max("verdict") < fail_on).alias("passed"))


def findings(verdicts: DataFrame, fail_on: int) -> DataFrame:
    """Rows at or above ``fail_on``, verdicts by name."""
    return verdicts.where(F.col("verdict") >= fail_on).withColumn("verdict", verdict_name(F.col("verdict")))


def verdict_cube(verdicts: DataFrame) -> DataFrame:
    """Counts by ecosystem and verdict with all subtotals; nulls stand for all."""
    return verdicts.cube("ecosystem", "verdict").agg(F.count(F.lit(1)).alias("n"))
