from __future__ import annotations

import pytest

from plumbline.sources import lockfiles as L
from plumbline.sources import manifests as M

CASES = {
    "requirements.txt": ("# c\n-r x\nA.b==1.0 # y\nc[e] == 2.0 ; python_version>'3'\nd>=1\n", {("pypi", "A.b", "1.0", True), ("pypi", "c", "2.0", True)}),
    "go.sum": ("a.b/c v1.0.0 h1:x=\na.b/c v1.0.0/go.mod h1:y=\nbad line\nz 1.0 h1:q\n", {("go", "a.b/c", "v1.0.0", False)}),
    "gradle.lockfile": ("# x\ng:a:1.0=compile\nempty=\n", {("maven", "g:a", "1.0", False)}),
    "mix.lock": ('%{\n  "jason": {:hex, :jason, "1.4.0", "h"},\n  "g": {:git, "https://x", "r", []},\n}\n', {("hex", "jason", "1.4.0", False), ("hex", "g", "", False)}),
    "cpanfile.snapshot": ("  Foo-Bar-1.2\n    pathname: A/AB/Foo-Bar-1.2.tar.gz\n", {("cpan", "Foo::Bar", "1.2", False)}),
    "cabal.project.freeze": ("constraints: any.aeson ==2.0.1,\n             text ==1.2\n", {("hackage", "aeson", "2.0.1", False), ("hackage", "text", "1.2", False)}),
    "stack.yaml.lock": ("- completed:\n    hackage: aeson-2.0.1@sha256:00,1\n", {("hackage", "aeson", "2.0.1", False)}),
    "Cargo.lock": ('version = 3\n\n[[package]]\nname = "a"\nversion = "1.0"\n\n[[package]]\nname = "b"\nversion = "2.0"\n\n[metadata]\nname = "no"\n', {("crates", "a", "1.0", False), ("crates", "b", "2.0", False)}),
    "poetry.lock": ('[[package]]\nname = "p"\nversion = "1"\n\n[package.dependencies]\nname = "x"\n', {("pypi", "p", "1", False)}),
    "Pipfile.lock": ('{"default":{"a":{"version":"==1"}},"develop":{"b":{"version":"==2"},"c":{}}}', {("pypi", "a", "1", True), ("pypi", "b", "2", True)}),
    "composer.lock": ('{"packages":[{"name":"a/b","version":"v1"}],"packages-dev":[{"name":"x","version":"1"}]}', {("packagist", "a/b", "v1", False)}),
    "packages.lock.json": ('{"dependencies":{"net6":{"A":{"type":"Direct","resolved":"1"},"B":{"type":"Transitive","resolved":"2"}},"net7":{"A":{"type":"Transitive","resolved":"1"}}}}', {("nuget", "A", "1", True), ("nuget", "B", "2", False)}),
    "renv.lock": ('{"Packages":{"x":{"Package":"x","Version":"1"}}}', {("cran", "x", "1", False)}),
    "Package.resolved": ('{"version":2,"pins":[{"location":"https://h/a","state":{"version":"1"}},{"location":"https://h/b","state":{"revision":"r"}}]}', {("swifturl", "https://h/a", "1", False), ("swifturl", "https://h/b", "r", False)}),
    "conan.lock": ('{"requires":["a/1#r%2"],"build_requires":["b/2"],"python_requires":[]}', {("conan", "a", "1", False), ("conan", "b", "2", False)}),
    "flake.lock": ('{"root":"root","nodes":{"root":{},"n":{"locked":{"rev":"abc"}},"m":{"locked":{"narHash":"h"}}}}', {("nix", "n", "abc", False), ("nix", "m", "h", False)}),
    "nimble.lock": ('{"packages":{"a":{"version":"1"}}}', {("nim", "a", "1", False)}),
    "elm.json": ('{"type":"application","dependencies":{"direct":{"a/b":"1"},"indirect":{"c/d":"2"}},"test-dependencies":{"direct":{},"indirect":{}}}', {("elm", "a/b", "1", True), ("elm", "c/d", "2", False)}),
    "yarn.lock": ('# v1\n\n"@s/a@^1", "@s/a@~1":\n  version "1.2.0"\n\nb@workspace:.:\n  version: 0.0.0\n\n__metadata:\n  version: 6\n\nc@npm:^2:\n  version: 2.1.0\n', {("npm", "@s/a", "1.2.0", False), ("npm", "c", "2.1.0", False)}),
    "pnpm-lock.yaml": ("packages:\n  /@s/a@1.0.0(x@1):\n    resolution: {}\n  /b/2.0.0:\n    dev: true\n\nsnapshots:\n  z@1:\n", {("npm", "@s/a", "1.0.0", False), ("npm", "b", "2.0.0", False)}),
    "bun.lock": ('{ // c\n "packages": {"a": ["a@1.0.0", "", {}], "b//": ["@s/b@2.0.0"],},\n}', {("npm", "a", "1.0.0", False), ("npm", "@s/b", "2.0.0", False)}),
    "package-lock.json": ('{"lockfileVersion":3,"packages":{"":{"dependencies":{"a":"1"}},"node_modules/a":{"version":"1"},"node_modules/a/node_modules/@s/b":{"version":"2"}}}', {("npm", "a", "1", True), ("npm", "@s/b", "2", False)}),
    "old/package-lock.json": ('{"lockfileVersion":1,"dependencies":{"a":{"version":"1","dependencies":{"b":{"version":"2"}}}}}', {("npm", "a", "1", False), ("npm", "b", "2", False)}),
    "Gemfile.lock": ("GIT\n  specs:\n    g (1)\n\nGEM\n  specs:\n    rack (2.0)\n      sub (>= 1)\n    rake (13)\n\nDEPENDENCIES\n  rack (~> 2)\n  local!\n", {("rubygems", "rack", "2.0", True), ("rubygems", "rake", "13", False)}),
    "pom.xml": ('<project xmlns="x"><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency><dependency><groupId>g</groupId><artifactId>t</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>', {("maven", "g:a", "1", True)}),
    "manifest.toml": ('packages = [\n  { name = "gleam_stdlib", version = "0.3" },\n]\n', {("hex", "gleam_stdlib", "0.3", False)}),
    "pubspec.lock": ('packages:\n  a:\n    dependency: "direct main"\n    source: hosted\n    version: "1.0"\n  s:\n    dependency: transitive\n    source: sdk\n    version: "0"\nsdks:\n  dart: x\n', {("pub", "a", "1.0", True)}),
    "Podfile.lock": ("PODS:\n  - A (1.0):\n    - B\n  - A/Sub (1.0)\n  - B (2.0)\n\nDEPENDENCIES:\n  - A (~> 1)\n", {("cocoapods", "A", "1.0", True), ("cocoapods", "B", "2.0", False)}),
    "Manifest.toml": ('[[deps.Foo]]\nversion = "1.0"\n\n[[deps.Std]]\nuuid = "x"\n', {("julia", "Foo", "1.0", False)}),
    "conda-lock.yml": ("package:\n- name: n\n  version: '1'\n  manager: conda\n- name: p\n  version: '2'\n  manager: pip\n", {("conda", "n", "1", False), ("pypi", "p", "2", False)}),
    "x.opam.locked": ('depends: [\n  "a" {= "1.0"}\n  "b" {>= "2"}\n]\n', {("opam", "a", "1.0", False)}),
}


def test_every_lockfile_format(spark):
    files = spark.createDataFrame([(f"p/{k}", t) for k, (t, _) in CASES.items()] + [("p/readme.md", "x==1"), ("p/empty/go.sum", ""), ("p/null/go.sum", None)], "path string, text string")
    got = {}
    for r in L.parse_lockfiles(files).collect():
        got.setdefault(r["path"][2:], []).append((r["ecosystem"], r["name"], r["version"], r["direct"]))
    for name, (_, want) in CASES.items():
        assert sorted(got.get(name, [])) == sorted(want), name
    assert set(got) == set(CASES)


def test_a_corrupt_file_gives_an_error_row(spark):
    broken = spark.createDataFrame([("a/pom.xml", "<project>"), ("a/elm.json", "{"), ("a/notes.txt", "x"), ("b/package-lock.json", "")], "path string, text string")
    got = {r["path"]: (r["error"], r["name"]) for r in L.parse_lockfiles(broken).collect()}
    assert set(got) == {"a/pom.xml", "a/elm.json", "b/package-lock.json"} and all(e.startswith("no valid") and n is None for e, n in got.values())


def test_one_lockfile_an_ecosystem(spark):
    names = ["a/package-lock.json", "a/yarn.lock", "a/requirements.txt", "b/package-lock.json", "yarn.lock", "package-lock.json", "a/x.opam.locked", "a/y.opam.locked", "a/other"]
    got = {r["path"] for r in L.first_of_ecosystem(spark.createDataFrame([(n, "") for n in names], "path string, text string")).collect()}
    assert got == {"a/yarn.lock", "a/requirements.txt", "b/package-lock.json", "yarn.lock", "a/x.opam.locked"}


def test_unpinned(spark):
    assert [(r[0], r[1]) for r in L.unpinned_requirements(spark.createDataFrame([("requirements.txt", "a\nb==1\n-r x\n#c\n")], "path string, text string")).collect()] == [("requirements.txt", 1)]


def test_manifests(spark):
    text = '{"name":"p","dependencies":{"a":"^1"},"optionalDependencies":{"g":"o/r#0123456789012345678901234567890123456789"},"scripts":{"postinstall":"x","test":"y"},"files":["lib"]}'
    files = spark.createDataFrame([("p/package.json", text), ("p/go.mod", "module x\nretract v1.0.0 // bad\nretract (\n [v1.1.0, v1.2.0]\n v1.5.0\n)\n")], "path string, text string")
    assert {(r["dep_name"], r["dep_group"], r["dep_source"]) for r in M.npm_dependencies(files).collect()} == {("a", "runtime", "registry"), ("g", "optional", "vcs")}
    assert [r["phase"] for r in M.npm_hooks(files).collect()] == ["postinstall"]
    assert [r["listed"] for r in M.npm_listed_files(files).collect()] == ["lib"]
    assert {(r["low"], r["high"]) for r in M.go_retractions(files).collect()} == {("v1.0.0", "v1.0.0"), ("v1.1.0", "v1.2.0"), ("v1.5.0", "v1.5.0")}


def test_npmrc(spark):
    files = spark.createDataFrame([("a/.npmrc", "registry=https://r/\n@s:registry = https://s\n//s/:_authToken=abc\n# registry=no\n")], "path string, text string")
    assert {(r["scope"], r["url"]) for r in M.npmrc_registries(files).collect()} == {("", "https://r"), ("@s", "https://s")}
    assert [r["host"] for r in M.npmrc_tokens(files).collect()] == ["s"]
