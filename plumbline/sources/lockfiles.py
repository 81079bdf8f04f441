"""Lockfile and manifest parsers: (path, text) rows to dependency rows.

Line-shaped formats are Column expressions over exploded lines; JSON formats use from_json with fixed schemas; the
formats that need a real parser or line state run in one Arrow function, a file at a time. A file name picks its parser.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small
from ..functions.rules import lines
from ..shared import write_table

OUT = ("path", "ecosystem", "name", "version", "direct")


def _rows(files: DataFrame, file_name: str) -> DataFrame:
    """Numbered lines of the files of a name."""
    return files.where(_base("path") == file_name).select("path", F.posexplode(lines(F.col("text"))).alias("pos", "line"))


def _base(path: str) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)\z", 1)


def _out(rows: DataFrame, ecosystem: str, name: Column, version: Column, direct=False) -> DataFrame:
    return rows.select("path", F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"), (F.lit(direct) if isinstance(direct, bool) else direct).alias("direct"))


def requirements(files: DataFrame) -> DataFrame:
    """``name==version`` pins; comments, options, extras and markers dropped; all direct, repeats kept."""
    rows = _rows(files, "requirements.txt").withColumn("line", F.trim(F.regexp_replace("line", r"(?:\A|\s)#.*", "")))
    rows = rows.where("line <> '' and not startswith(line, '-')")
    pin = r"\A([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*==\s*([A-Za-z0-9._!+*-]+)\s*(?:;.*|\s.*)?\z"
    return _out(rows.where(F.col("line").rlike(pin)), "pypi", F.regexp_extract("line", pin, 1), F.regexp_extract("line", pin, 2), True)


def unpinned_requirements(files: DataFrame) -> DataFrame:
    """(path, dropped): how many requirement lines have no pin."""
    rows = _rows(files, "requirements.txt").withColumn("line", F.trim(F.regexp_replace("line", r"(?:\A|\s)#.*", ""))).where("line <> '' and not startswith(line, '-')")
    return rows.groupBy("path").agg(F.count_if(~F.col("line").rlike(r"==")).alias("dropped"))


def go_sum(files: DataFrame) -> DataFrame:
    """``module version h1:hash`` lines; ``/go.mod`` stripped; distinct."""
    parts = F.split(F.trim(F.col("line")), r"\s+")
    rows = _rows(files, "go.sum").where(F.size(parts) == 3).select("path", parts[0].alias("m"), F.regexp_replace(parts[1], r"/go\.mod\z", "").alias("v"), parts[2].alias("h"))
    rows = rows.where(F.col("v").startswith("v") & F.col("h").startswith("h1:") & F.col("m").rlike(r"\A[A-Za-z0-9._~/!-]+\z")).select("path", "m", "v").distinct()
    return _out(rows, "go", F.col("m"), F.col("v"))


def gradle(files: DataFrame) -> DataFrame:
    """``group:artifact:version=configurations``."""
    pin = r"\A([^:#=\s]+:[^:=\s]+):([^:=\s]+)="
    rows = _rows(files, "gradle.lockfile").where(F.col("line").rlike(pin) & ~F.col("line").startswith("empty="))
    return _out(rows, "maven", F.regexp_extract("line", pin, 1), F.regexp_extract("line", pin, 2))


def mix(files: DataFrame) -> DataFrame:
    """``:hex`` entries, and ``:git`` entries without a version."""
    hex_pin, git = r'"([^"]+)":\s*\{:hex,\s*:[^,]+,\s*"([^"]+)"', r'"([^"]+)":\s*\{:git,'
    rows = _rows(files, "mix.lock").where(F.col("line").rlike(hex_pin) | F.col("line").rlike(git))
    return _out(rows, "hex", F.regexp_extract("line", r'"([^"]+)":', 1), F.regexp_extract("line", hex_pin, 2))


def cpan(files: DataFrame) -> DataFrame:
    """``pathname:`` tarballs; distinct."""
    pin = r"\A\s*pathname:\s*\S*/([A-Za-z0-9_.-]+?)-v?([0-9][0-9A-Za-z._]*)\.(?:tar\.gz|tgz|zip|tar\.bz2)\s*\z"
    rows = _rows(files, "cpanfile.snapshot").where(F.col("line").rlike(pin)).select("path", F.regexp_extract("line", pin, 1).alias("n"), F.regexp_extract("line", pin, 2).alias("v")).distinct()
    return _out(rows, "cpan", F.regexp_replace("n", "-", "::"), F.col("v"))


def cabal(files: DataFrame) -> DataFrame:
    """``any.name ==version`` pins of a freeze file, one or more a line."""
    pin = r"(?:any\.)?([A-Za-z0-9-]+)\s*==\s*([0-9][0-9.]*)"
    rows = _rows(files, "cabal.project.freeze").where(~F.col("line").rlike(r"\A\s*--")).select("path", F.explode(F.regexp_extract_all("line", F.lit(pin), F.lit(0))).alias("pin"))
    return _out(rows, "hackage", F.regexp_extract("pin", pin, 1), F.regexp_extract("pin", pin, 2))


def stack(files: DataFrame) -> DataFrame:
    """``hackage: name-version@sha256`` entries; distinct."""
    pin = r"hackage:\s*([A-Za-z0-9-]+?)-([0-9][0-9.]*)(?:@|\s|\z)"
    rows = _rows(files, "stack.yaml.lock").where(F.col("line").rlike(pin)).select("path", F.regexp_extract("line", pin, 1).alias("n"), F.regexp_extract("line", pin, 2).alias("v")).distinct()
    return _out(rows, "hackage", F.col("n"), F.col("v"))


def _tables(files: DataFrame, file_name: str, ecosystem: str) -> DataFrame:
    """``[[package]]`` tables with double-quoted name and version."""
    rows = files.where(_base("path") == file_name).select("path", F.explode(F.slice(F.split("text", r"(?m)^\[\[package\]\]\s*$"), F.lit(2), F.greatest(F.size(F.split("text", r"(?m)^\[\[package\]\]\s*$")), F.lit(2)))).alias("body"))
    body = F.split_part(F.regexp_replace("body", r"(?m)^\[", "\x00["), F.lit("\x00"), F.lit(1))
    field = lambda k: F.regexp_extract(body, rf'(?m)^{k}\s*=\s*"([^"]*)"', 1)
    return _out(rows.where((field("name") != "") & (field("version") != "")), ecosystem, field("name"), field("version"))


def cargo(files: DataFrame) -> DataFrame:
    return _tables(files, "Cargo.lock", "crates")


def poetry(files: DataFrame) -> DataFrame:
    return _tables(files, "poetry.lock", "pypi")


def uv(files: DataFrame) -> DataFrame:
    return _tables(files, "uv.lock", "pypi")


def _json(files: DataFrame, file_name: str, schema: str) -> DataFrame:
    return files.where(_base("path") == file_name).select("path", F.from_json("text", schema).alias("d"))


def pipfile(files: DataFrame) -> DataFrame:
    """default and develop sections; ``==`` stripped; all direct."""
    part = "map<string,struct<version:string>>"
    rows = _json(files, "Pipfile.lock", f"default {part}, develop {part}")
    both = rows.select("path", F.explode_outer("d.default").alias("n", "x")).unionByName(rows.select("path", F.explode_outer("d.develop").alias("n", "x")))
    return _out(both.where("x.version is not null and x.version <> ''"), "pypi", F.col("n"), F.regexp_replace("x.version", r"\A==", ""), True)


def npm(files: DataFrame) -> DataFrame:
    """Flat ``packages`` of version 2 and 3 lockfiles: name after the last node_modules, distinct; direct by the root's sections."""
    deps = "map<string,string>"
    rows = _json(files, "package-lock.json", f"packages map<string,struct<version:string,name:string,link:boolean,dependencies:{deps},devDependencies:{deps},optionalDependencies:{deps},peerDependencies:{deps}>>")
    root = F.try_element_at("d.packages", F.lit(""))
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    direct = F.concat(keys(root["dependencies"]), keys(root["devDependencies"]), keys(root["optionalDependencies"]), keys(root["peerDependencies"]))
    each = rows.withColumn("direct_names", direct).select("path", "direct_names", F.explode("d.packages").alias("at", "p")).where("at <> '' and coalesce(p.version, '') <> ''")
    each = each.withColumn("n", F.element_at(F.split("at", "node_modules/"), -1))
    each = each.groupBy("path", "n", F.col("p.version").alias("v")).agg(F.first("direct_names").alias("direct_names"))
    return _out(each, "npm", F.col("n"), F.col("v"), F.array_contains("direct_names", F.col("n")))


def composer(files: DataFrame) -> DataFrame:
    rows = _json(files, "composer.lock", "packages array<struct<name:string,version:string>>").select("path", F.explode("d.packages").alias("p"))
    return _out(rows.where("coalesce(p.name, '') <> ''"), "packagist", F.col("p.name"), F.coalesce("p.version", F.lit("")))


def nuget(files: DataFrame) -> DataFrame:
    """All target frameworks together, distinct; ``Direct`` entries are direct."""
    rows = _json(files, "packages.lock.json", "dependencies map<string,map<string,struct<type:string,resolved:string>>>")
    each = rows.select("path", F.explode("d.dependencies").alias("tfm", "ps")).select("path", F.explode("ps").alias("n", "p")).where("coalesce(p.resolved, '') <> ''")
    each = each.groupBy("path", "n", F.col("p.resolved").alias("v")).agg(F.max(F.col("p.type") == "Direct").alias("direct"))
    return _out(each, "nuget", F.col("n"), F.col("v"), F.coalesce("direct", F.lit(False)))


def renv(files: DataFrame) -> DataFrame:
    rows = _json(files, "renv.lock", "Packages map<string,struct<Package:string,Version:string>>").select("path", F.explode("d.Packages").alias("k", "p"))
    return _out(rows.where("coalesce(p.Version, '') <> ''"), "cran", F.coalesce("p.Package", "k"), F.col("p.Version"))


def swift(files: DataFrame) -> DataFrame:
    """Version 2 pins by location, others by repositoryURL; the revision stands in for a version."""
    state = "state struct<version:string,revision:string>"
    rows = _json(files, "Package.resolved", f"version int, pins array<struct<location:string,{state.replace(' ', ':', 1)}>>, object struct<pins:array<struct<repositoryURL:string,{state.replace(' ', ':', 1)}>>>")
    new = rows.where("d.version = 2").select("path", F.explode("d.pins").alias("p")).select("path", F.col("p.location").alias("n"), "p.state")
    old = rows.where("not (d.version <=> 2)").select("path", F.explode("d.object.pins").alias("p")).select("path", F.col("p.repositoryURL").alias("n"), "p.state")
    v = F.coalesce(F.nullif("state.version", F.lit("")), "state.revision", F.lit(""))
    return _out(new.unionByName(old).where(v != ""), "swifturl", F.col("n"), v)


def conan(files: DataFrame) -> DataFrame:
    rows = _json(files, "conan.lock", "requires array<string>, build_requires array<string>, python_requires array<string>")
    refs = F.concat(*[F.coalesce(f"d.{k}", F.array().cast("array<string>")) for k in ("requires", "build_requires", "python_requires")])
    pin = r"\A([^/]+)/([^#@%]+)"
    each = rows.select("path", F.explode(refs).alias("r")).where(F.col("r").rlike(pin)).select("path", F.regexp_extract("r", pin, 1).alias("n"), F.regexp_extract("r", pin, 2).alias("v")).distinct()
    return _out(each, "conan", F.col("n"), F.col("v"))


def flake(files: DataFrame) -> DataFrame:
    """All nodes but the root; the revision, else the hash."""
    rows = _json(files, "flake.lock", "root string, nodes map<string,struct<locked:struct<rev:string,narHash:string>>>").select("path", "d.root", F.explode("d.nodes").alias("n", "x"))
    v = F.coalesce(F.nullif("x.locked.rev", F.lit("")), F.nullif("x.locked.narHash", F.lit("")))
    return _out(rows.where((F.col("n") != F.coalesce("root", F.lit("root"))) & v.isNotNull()), "nix", F.col("n"), v)


def nimble(files: DataFrame) -> DataFrame:
    rows = _json(files, "nimble.lock", "packages map<string,struct<version:string>>").select("path", F.explode("d.packages").alias("n", "p"))
    return _out(rows.where("coalesce(p.version, '') <> ''"), "nim", F.col("n"), F.col("p.version"))


def elm(files: DataFrame) -> DataFrame:
    """Applications only; direct and indirect buckets; distinct."""
    bucket = "struct<direct:map<string,string>,indirect:map<string,string>>"
    rows = _json(files, "elm.json", f"type string, dependencies {bucket}, `test-dependencies` {bucket}").where("d.type = 'application'")
    parts = [rows.select("path", F.explode(F.col("d")[k][b]).alias("n", "v"), F.lit(b == "direct").alias("direct")) for k in ("dependencies", "test-dependencies") for b in ("direct", "indirect")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    each = every.groupBy("path", "n", "v").agg(F.max("direct").alias("direct"))
    return _out(each, "elm", F.col("n"), F.col("v"), F.col("direct"))


# Formats with line state or nested syntax: functions of a whole text that give (ecosystem, name, version, direct).


def _yarn(text: str):
    name, seen, skip, version = None, set(), False, None

    def entry():
        if name and version and not skip and (name, version) not in seen:
            seen.add((name, version))
            yield "npm", name, version, False

    for line in text.splitlines():
        if line and not line[0].isspace() and line.rstrip().endswith(":") and not line.startswith("#"):
            yield from entry()
            head = line.rstrip()[:-1].split(",")[0].strip().strip('"')
            at = head.find("@", 1)
            name, version, skip = (head[:at] if at > 0 else head), None, head == "__metadata" or bool(re.search(r"@(?:workspace|file|link|portal):", head))
        elif m := re.match(r"\s+version:?\s+\"?([^\"\s]+)\"?", line):
            version = version or m[1]
        elif re.match(r"\s+(?:resolved \s*\"?(?:file|link|portal):|resolution:.*@workspace:)", line):
            skip = True  # a local folder, however the entry is named
    yield from entry()


def _pnpm(text: str):
    inside, seen = False, set()
    for line in text.splitlines():
        if line and not line[0].isspace():
            inside = line.startswith("packages:")
        elif inside and (m := re.match(r"  (\S.*):\s*$", line)) and line[2] != " ":
            key = re.sub(r"\(.*", "", m[1].strip().strip("'\"")).lstrip("/")
            at = key.rfind("@")
            name, version = (key[:at], key[at + 1 :]) if at > 0 else key.rpartition("/")[::2]
            if name and version and (name, version) not in seen:
                seen.add((name, version))
                yield "npm", name, version, False


def _bun(text: str):
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    plain = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)
    seen = set()
    for entry in (json.loads(plain).get("packages") or {}).values():
        name, _, version = str(entry[0] if isinstance(entry, list) and entry else "").rpartition("@")
        if name and version and (name, version) not in seen:
            seen.add((name, version))
            yield "npm", name, version, False


def _gemfile(text: str):
    section, specs, direct = "", [], set()
    for line in text.splitlines():
        if line and not line[0].isspace():
            section = line.strip()
        elif section == "DEPENDENCIES" and line.strip():
            direct.add(re.split(r"[ !(]", line.strip())[0])
        elif section == "GEM" and (m := re.match(r"    ([^\s(]+) \(([^)]+)\)\s*$", line)):
            specs.append((m[1], m[2]))
    for name, version in specs:
        yield "rubygems", name, version, name in direct


def _pom(text: str):
    root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text))
    tag = lambda e: e.tag.rpartition("}")[2]
    for part in root:
        if tag(part) == "dependencies":
            for dep in part:
                field = {tag(x): (x.text or "").strip() for x in dep}
                if field.get("scope") != "test" and field.get("groupId") and field.get("artifactId") and field.get("version"):
                    yield "maven", f"{field['groupId']}:{field['artifactId']}", field["version"], True


def _gleam(text: str):
    for p in tomllib.loads(text).get("packages", []):
        if p.get("name") and p.get("version"):
            yield "hex", p["name"], p["version"], False


def _pubspec(text: str):
    name, field = None, {}

    def done():
        if name and field.get("version") and field.get("source") not in ("sdk", "path"):
            yield "pub", name, field.get("ref") or field["version"] if field.get("source") == "git" else field["version"], "direct" in field.get("dependency", "")

    for line in text.splitlines():
        if m := re.match(r"  ([A-Za-z0-9_]+):\s*$", line):
            yield from done()
            name, field = m[1], {}
        elif m := re.match(r"\s{4,}([a-z-]+):\s*\"?([^\"]*)\"?\s*$", line):
            field.setdefault(m[1], m[2].strip())
        elif line and not line[0].isspace():
            yield from done()
            name, field = None, {}
    yield from done()


def _podfile(text: str):
    section, pods, direct = "", [], set()
    for line in text.splitlines():
        if line and not line[0].isspace():
            section = line.strip().rstrip(":")
        elif section == "PODS" and (m := re.match(r"  - \"?([^\s(\"]+) \(([^)]+)\)", line)) and "/" not in m[1]:
            pods.append((m[1], m[2]))
        elif section == "DEPENDENCIES" and (m := re.match(r"  - \"?([^\s(\"]+)", line)):
            direct.add(m[1].split("/")[0])
    for name, version in pods:
        yield "cocoapods", name, version, name in direct


def _julia(text: str):
    for name, entries in tomllib.loads(text).get("deps", {}).items():
        for e in entries if isinstance(entries, list) else []:
            if e.get("version"):
                yield "julia", name, e["version"], False


def _conda(text: str):
    import yaml

    seen = set()
    for p in (yaml.safe_load(text) or {}).get("package") or []:
        row = ("pypi" if p.get("manager") == "pip" else "conda", str(p.get("name") or ""), str(p.get("version") or ""))
        if all(row) and row not in seen:
            seen.add(row)
            yield *row, False


def _opam(text: str):
    m = re.search(r"^depends:\s*\[(.*?)^\]", text, re.S | re.M)
    seen = set()
    for name, version in re.findall(r'"([^"]+)"\s*\{\s*=\s*"([^"]+)"[^}]*\}', m[1] if m else ""):
        if (name, version) not in seen:
            seen.add((name, version))
            yield "opam", name, version, False


def _npm_v1(text: str):
    seen, todo = set(), [json.loads(text).get("dependencies") or {}]
    while todo:
        for name, d in todo.pop().items():
            if isinstance(d, dict):
                if d.get("version") and (name, d["version"]) not in seen:
                    seen.add((name, d["version"]))
                    yield "npm", name, d["version"], False
                todo.append(d.get("dependencies") or {})


PARSERS: dict[str, Callable[[str], Iterator[tuple]]] = {
    "yarn.lock": _yarn, "pnpm-lock.yaml": _pnpm, "bun.lock": _bun, "Gemfile.lock": _gemfile, "pom.xml": _pom, "manifest.toml": _gleam,
    "pubspec.lock": _pubspec, "Podfile.lock": _podfile, "Manifest.toml": _julia, "conda-lock.yml": _conda,
}
COLUMN_FORMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "requirements.txt": requirements, "go.sum": go_sum, "gradle.lockfile": gradle, "mix.lock": mix, "cpanfile.snapshot": cpan, "cabal.project.freeze": cabal, "stack.yaml.lock": stack,
    "Cargo.lock": cargo, "poetry.lock": poetry, "uv.lock": uv, "Pipfile.lock": pipfile, "package-lock.json": npm, "composer.lock": composer, "packages.lock.json": nuget, "renv.lock": renv,
    "Package.resolved": swift, "conan.lock": conan, "flake.lock": flake, "nimble.lock": nimble, "elm.json": elm,
}
JSON_FORMS = ("Pipfile.lock", "package-lock.json", "composer.lock", "packages.lock.json", "renv.lock", "Package.resolved", "conan.lock", "flake.lock", "nimble.lock", "elm.json")
OPAM = "*.opam.locked"
# Lockfiles in order of preference, with their ecosystems; of a folder's files the first of an ecosystem counts.
PREFERENCE = [
    ("pnpm-lock.yaml", "npm"), ("yarn.lock", "npm"), ("bun.lock", "npm"), ("package-lock.json", "npm"), ("poetry.lock", "pypi"), ("uv.lock", "pypi"), ("Pipfile.lock", "pypi"),
    ("requirements.txt", "pypi"), ("Cargo.lock", "crates"), ("go.sum", "go"), ("composer.lock", "packagist"), ("packages.lock.json", "nuget"), ("renv.lock", "cran"), ("Package.resolved", "swifturl"),
    ("Gemfile.lock", "rubygems"), ("gradle.lockfile", "maven"), ("pom.xml", "maven"), ("manifest.toml", "hex"), ("mix.lock", "hex"), ("pubspec.lock", "pub"), ("Podfile.lock", "cocoapods"),
    ("cpanfile.snapshot", "cpan"), ("cabal.project.freeze", "hackage"), ("stack.yaml.lock", "hackage"), ("conan.lock", "conan"), ("flake.lock", "nix"), ("Manifest.toml", "julia"),
    ("conda-lock.yml", "conda"), ("nimble.lock", "nim"), ("elm.json", "elm"), (OPAM, "opam"),
]
PARSED = "path string, ecosystem string, name string, version string, direct boolean, error string"


def lock_kind(path: str = "path") -> Column:
    """The file name that picks a parser, or null."""
    base = _base(path)
    return F.when(base.isin(*[n for n, _ in PREFERENCE]), base).when(F.col(path).endswith(".opam.locked"), OPAM)


def first_of_ecosystem(files: DataFrame) -> DataFrame:
    """Of the lockfiles in one folder those that come first in their ecosystem; texts are not shuffled, only paths are."""
    rank = F.create_map(*[F.lit(x) for k, (n, _) in enumerate(PREFERENCE) for x in (n, k)])
    eco = F.create_map(*[F.lit(x) for n, e in PREFERENCE for x in (n, e)])
    paths = files.select("path", lock_kind().alias("kind")).where("kind is not null")
    paths = paths.select("path", F.regexp_replace("path", r"[^/\\\\]+\z", "").alias("folder"), F.element_at(eco, F.col("kind")).alias("eco"), F.element_at(rank, F.col("kind")).alias("rank"))
    best = paths.groupBy("folder", "eco").agg(F.min_by("path", F.struct("rank", "path")).alias("path")).select("path")
    return files.join(best, "path", "left_semi")


def stateful(files: DataFrame) -> DataFrame:
    """Files whose formats need a parser; one that does not parse gives a single row with its ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = re.split(r"[/\\]", path)[-1]
                parse = PARSERS.get(base) or (_opam if base.endswith(".opam.locked") else _npm_v1)
                try:
                    rows += [(path, *r, None) for r in list(parse(text or ""))]
                except Exception as e:  # whatever a parser makes of a broken file
                    rows.append((path, None, None, None, None, f"no valid {base}: {type(e).__name__}"))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*OUT, "error"])

    old_npm = (_base("path") == "package-lock.json") & F.try_parse_json("text").isNotNull() & F.get_json_object("text", "$.packages").isNull()
    mine = files.where(_base("path").isin(*PARSERS) | F.col("path").endswith(".opam.locked") | old_npm)
    return mine.select("path", "text").mapInArrow(run, PARSED)


def parse_lockfiles(files: DataFrame) -> DataFrame:
    """Dependencies (path, ecosystem, name, version, direct, error) of all files of known names.

    Files are read once: those of known names are written to folders by name in the shared folder, and each parser reads
    its own. A file that is no valid document of its kind gives one row with an ``error`` and nothing else.
    """
    table, _ = write_table(files.select("path", "text", lock_kind().alias("kind")).where("kind is not null"), "lockfiles", ("kind",))
    out = stateful(table.where(F.col("kind").isin(*PARSERS, OPAM, "package-lock.json")))
    for name, form in COLUMN_FORMS.items():
        out = out.unionByName(form(table.where(F.col("kind") == name)).withColumn("error", F.lit(None).cast("string")))
    broken = table.where(F.col("kind").isin(*JSON_FORMS) & F.try_parse_json("text").isNull())
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ecosystem", "string"), ("name", "string"), ("version", "string"), ("direct", "boolean"))]
    return out.unionByName(broken.select("path", *none, F.concat(F.lit("no valid "), "kind").alias("error")))


def lockfile_dependencies(files: DataFrame) -> DataFrame:
    """The dependencies of each folder's preferred lockfiles; broken files are left out."""
    return parse_lockfiles(first_of_ecosystem(files)).where("error is null").drop("error")


def npm_edges(files: DataFrame) -> DataFrame:
    """(path, name, version, depends_on): for each package of a flat lockfile the keys ``npm/name@version`` it depends on.

    A name stands for its shallowest copy; of copies of one version the shallowest tells the dependencies.
    """
    rows = _json(files, "package-lock.json", "packages map<string,struct<version:string,dependencies:map<string,string>>>").select("path", F.explode("d.packages").alias("at", "p"))
    rows = rows.where("at <> '' and coalesce(p.version, '') <> ''").select("path", "at", F.element_at(F.split("at", "node_modules/"), -1).alias("name"), F.col("p.version").alias("version"), F.map_keys("p.dependencies").alias("needs")).where("name <> ''")
    depth = F.struct(F.octet_length("at"), F.col("at"))
    # dealt by file once: versions, then names, then who needs a name meet there
    each = rows.repartition("path").groupBy("path", "name", "version").agg(F.min(F.struct(depth.alias("depth"), F.struct("needs").alias("n"))).alias("first"))
    named = each.groupBy("path", "name").agg(F.min_by("version", "first.depth").alias("top"), F.collect_list(F.struct("version", F.col("first.n.needs").alias("needs"))).alias("versions"))
    word = F.lit(None).cast("string")
    said = lambda key, top, name, version: F.struct(key.alias("key"), top.alias("top"), name.alias("name"), version.alias("version"))
    asks = F.flatten(F.transform("versions", lambda v: F.transform(F.coalesce(v["needs"], F.array().cast("array<string>")), lambda k: said(k, word, F.col("name"), v["version"]))))
    met = named.select("path", F.explode(F.concat(F.array(said(F.col("name"), F.col("top"), word, word)), asks)).alias("x")).select("path", "x.*")
    met = met.groupBy("path", "key").agg(F.max("top").alias("top"), F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "version"))).alias("asks")).where("top is not null")
    found = met.select("path", F.explode("asks").alias("a"), F.concat(F.lit("npm/"), "key", F.lit("@"), "top").alias("need")).select("path", "a.*", "need")
    return found.groupBy("path", "name", "version").agg(F.array_sort(F.collect_set("need")).alias("depends_on"))


def read_files(spark, path: str, most_bytes: int = 4 << 20) -> DataFrame:
    """(path, text) of the files under a path, larger ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most_bytes)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
