"""Lockfiles of all formats, written from line items and parsed back in one pass, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..shared import spread
from ..sources import lockfiles as L
from . import derived as D
from .rule_queries import pick, q, sql_list

#: File name, ecosystem, head, entry (N name, V version), what parts entries, foot, whether entries are direct; names begin with n.
FORMATS = [
    ("pnpm-lock.yaml", "npm", "lockfileVersion: '9.0'\n\npackages:\n\n", "  'N@V':\n    resolution: {integrity: sha512-x}", "\n\n", "\n\nsnapshots:\n\n  zzz@9.9.9: {}\n", False),
    ("yarn.lock", "npm", "# yarn lockfile v1\n\n", '"N@^1.0.0", N@~1:\n  version "V"\n  resolved "https://r.example/x.tgz"\n  dependencies:\n    zzz "^9.0.0"', "\n\n", '\n\n"local@file:../l":\n  version "0.0.0"\n\nfolder@^1.0.0:\n  version "1.0.0"\n  resolved "file:packages/x"\n\n"linked@npm:^1":\n  version: 1.0.0\n  resolution: "linked@workspace:y"\n', False),
    ("bun.lock", "npm", '{\n  // text\n  "lockfileVersion": 1,\n  "packages": {\n', '    "N": ["N@V", "", {}, "sha512-x"]', ",\n", ",\n  },\n}\n", False),
    ("poetry.lock", "pypi", "# generated\n\n", '[[package]]\nname = "N"\nversion = "V"\ndescription = "x"\n\n[package.dependencies]\nzzz = ">=9"', "\n\n", "\n\n[metadata]\nlock-version = \"2.0\"\n", False),
    ("uv.lock", "pypi", "version = 1\n\n", '[[package]]\nname = "N"\nversion = "V"\nsource = { registry = "https://r.example" }', "\n\n", "\n", False),
    ("Pipfile.lock", "pypi", '{"_meta":{},"default":{', '"N":{"hashes":[],"version":"==V"}', ",", '},"develop":{}}', True),
    ("composer.lock", "packagist", '{"packages":[', '{"name":"N","version":"V"}', ",", "]}", False),
    ("packages.lock.json", "nuget", '{"version":1,"dependencies":{"net8.0":{', '"N":{"type":"Direct","requested":"[1, )","resolved":"V"}', ",", "}}}", True),
    ("renv.lock", "cran", '{"R":{"Version":"4.3.0"},"Packages":{', '"N":{"Package":"N","Version":"V","Source":"Repository"}', ",", "}}", False),
    ("Package.resolved", "swifturl", '{"version":2,"pins":[', '{"identity":"x","kind":"remoteSourceControl","location":"N","state":{"revision":"abc","version":"V"}}', ",", "]}", False),
    ("pom.xml", "maven", '<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies>', "<dependency><groupId>g.x</groupId><artifactId>N</artifactId><version>V</version></dependency>", "", "<dependency><groupId>g.t</groupId><artifactId>t</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>", True),
    ("manifest.toml", "hex", "packages = [\n", '  { name = "N", version = "V", build_tools = ["gleam"], requirements = [] }', ",\n", ",\n]\n", False),
    ("mix.lock", "hex", "%{\n", '  "N": {:hex, :N, "V", "abc", [:mix], [], "hexpm", "def"}', ",\n", ",\n}\n", False),
    ("pubspec.lock", "pub", "packages:\n", '  N:\n    dependency: "direct main"\n    description:\n      name: N\n      url: "https://pub.example"\n    source: hosted\n    version: "V"', "\n", "\nsdks:\n  dart: \">=3.0.0 <4.0.0\"\n", True),
    ("Podfile.lock", "cocoapods", "PODS:\n", "  - N (V)", "\n", "\n  - Sub/Core (9.9)\n\nDEPENDENCIES:\n  - Other\n\nCOCOAPODS: 1.12.0\n", False),
    ("cpanfile.snapshot", "cpan", "# carton snapshot format: version 1.0\nDISTRIBUTIONS\n", "  N-V\n    pathname: A/AU/AUTHOR/N-V.tar.gz\n    provides:\n      N V", "\n", "\n", False),
    ("cabal.project.freeze", "hackage", "active-repositories: hackage.haskell.org:merge\nconstraints: ", "any.N ==V", ",\n             ", "\nindex-state: hackage.haskell.org 2024\n", False),
    ("stack.yaml.lock", "hackage", "packages:\n", "- completed:\n    hackage: N-V@sha256:abc,123\n  original:\n    hackage: N-V", "\n", "\nsnapshots: []\n", False),
    ("conan.lock", "conan", '{"version":"0.5","requires":[', '"N/V#abc%1.2"', ",", '],"build_requires":[],"python_requires":[]}', False),
    ("flake.lock", "nix", '{"nodes":{"root":{"inputs":{}},', '"N":{"locked":{"type":"github","rev":"V"}}', ",", '},"root":"root","version":7}', False),
    ("Manifest.toml", "julia", 'julia_version = "1.9.0"\nmanifest_format = "2.0"\n\n', '[[deps.N]]\nuuid = "x"\nversion = "V"', "\n\n", "\n", False),
    ("conda-lock.yml", "conda", "version: 1\npackage:\n", "- name: N\n  version: V\n  manager: conda\n  platform: linux-64", "\n", "\n", False),
    ("nimble.lock", "nim", '{"version":2,"packages":{', '"N":{"version":"V","vcsRevision":"abc"}', ",", '},"tasks":{}}', False),
    ("elm.json", "elm", '{"type":"application","dependencies":{"direct":{', '"N":"V"', ",", '},"indirect":{}},"test-dependencies":{"direct":{},"indirect":{}}}', True),
    ("x.opam.locked", "opam", 'opam-version: "2.0"\ndepends: [\n', '  "N" {= "V"}', "\n", '\n  "loose" {>= "1"}\n]\n', False),
]
BROKEN = [("package-lock.json", '{"packages": {'), ("pom.xml", "<project>"), ("Manifest.toml", "[[deps"), ("elm.json", "")]
NAME, VERSION = "concat('n', l_partkey)", "concat('1.', l_linenumber, '.', l_suppkey)"


def lockfile_formats(spark, d):
    """A lockfile an order, the format by its number, and a few broken ones."""
    at = (F.col("l_orderkey") % len(FORMATS) + 1).cast("int")
    rows = D.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", f"{NAME} as n", f"{VERSION} as v")
    marked = [re.sub(r"\bV\b", "\x02", re.sub(r"\bN\b", "\x01", f[3])) for f in FORMATS]
    entry = F.replace(F.replace(pick(marked, F.col("l_orderkey")), F.lit("\x01"), F.col("n")), F.lit("\x02"), F.col("v"))
    # one entry a name, as a map has
    rows = rows.withColumn("entry", entry).groupBy("l_orderkey", "n").agg(F.min_by(F.struct("l_linenumber", "entry"), F.struct("l_linenumber", "l_suppkey")).alias("e"))
    body = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["entry"])
    files = rows.groupBy("l_orderkey").agg(body.alias("es"))
    part = lambda k: F.element_at(F.array(*[F.lit(f[k]) for f in FORMATS]), at)
    text = F.concat(part(2), F.array_join("es", "\x03"), part(5))
    files = files.select(F.concat(F.lit("p"), "l_orderkey", F.lit("/"), part(0)).alias("path"), F.replace(text, F.lit("\x03"), part(4)).alias("text"))
    broken = spark.createDataFrame([(f"broken{k}/{name}", text) for k, (name, text) in enumerate(BROKEN)], "path string, text string")
    got = L.parse_lockfiles(files.unionByName(broken))
    return got.select("path", "ecosystem", "name", "version", "direct", F.col("error").isNotNull().alias("broken"))


_RENAMED = {"pom.xml": "'g.x:' || n"}
_NAMES = " ".join(f"WHEN {q(f)} THEN {e}" for f, e in _RENAMED.items())
ORACLES = {
    "lockfile_formats": f"""WITH r AS (SELECT l_orderkey, 'n' || l_partkey AS n, arg_min('1.' || l_linenumber || '.' || l_suppkey, l_linenumber * 10000000 + l_suppkey) AS v FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, CAST(l_orderkey % {len(FORMATS)} + 1 AS INT) AS k FROM r),
g AS (SELECT *, {sql_list([f[0] for f in FORMATS])}[k] AS file FROM f)
SELECT 'p' || l_orderkey || '/' || file AS path, {sql_list([f[1] for f in FORMATS])}[k] AS ecosystem, CASE file {_NAMES} ELSE n END AS name, v AS version, {[f[6] for f in FORMATS]}[k] AS direct, false AS broken FROM g
UNION ALL SELECT x, NULL, NULL, NULL, NULL, true FROM (SELECT unnest({sql_list([f"broken{k}/{name}" for k, (name, _) in enumerate(BROKEN)])}) AS x)""",
    "npm_depends_on": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, '3.' || l_linenumber || '.0' AS v FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, l_partkey, arg_min(v, l_linenumber) AS top FROM l GROUP BY 1, 2)
SELECT DISTINCT 'p' || a.l_orderkey || '/package-lock.json' AS path, 'n' || a.l_partkey AS name, a.v AS version, 'npm/n' || b.l_partkey || '@' || b.top AS needed
FROM l a JOIN l x ON x.l_orderkey = a.l_orderkey AND x.l_linenumber = a.l_linenumber + 1 JOIN t b ON b.l_orderkey = x.l_orderkey AND b.l_partkey = x.l_partkey""",
}


def npm_depends_on(spark, d):
    """Packages that depend on the next line item's; the deeper its folder, the later its line."""
    line = spread(D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    after = F.min("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1))
    rows = line.withColumn("need", after).selectExpr(
        "l_orderkey", "concat(repeat('node_modules/z/', cast(l_linenumber as int)), 'node_modules/n', l_partkey) as at", "concat('3.', l_linenumber, '.0') as v", "if(need is null, map('zzz', '*'), map(concat('n', need), '*')) as deps")
    packages = F.map_from_entries(F.collect_list(F.struct("at", F.struct(F.col("v").alias("version"), F.col("deps").alias("dependencies")))))
    files = rows.groupBy("l_orderkey").agg(F.to_json(F.struct(F.lit(3).alias("lockfileVersion"), packages.alias("packages"))).alias("text"))
    got = L.npm_edges(files.select(F.concat(F.lit("p"), "l_orderkey", F.lit("/package-lock.json")).alias("path"), "text"))
    return got.select("path", "name", "version", F.explode("depends_on").alias("needed"))


QUERIES = {f.__name__: f for f in (lockfile_formats, npm_depends_on)}
