"""Plans and passes that keep work in proportion to the input."""

from __future__ import annotations

import io
import json
import tarfile

import pytest

from plumbline import registry, shared
from plumbline.operators import reach
from plumbline.operators import reports as RP
from plumbline.sources import archives, lockfiles

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["image_overlay", "image_command"])
def test_images_are_unpacked_once(spark, name):
    """what is joined reads written entries, so no archive is packed or read again."""
    text = plan(registry.QUERIES[name](spark, SF))
    assert "image-entries" in text and "image:string" in text
    assert "image-files" not in text and "content#" not in text


def test_layers_send_many_entries_at_once(spark):
    """entries of many small layers share a batch."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        tar.addfile(tarfile.TarInfo("a"), io.BytesIO(b""))
    rows = [archives.entries(out.getvalue()) for _ in range(300)]
    got = list(archives._batches((("i", 0, *e) for r in rows for e in r), archives.SCHEMA))
    assert [b.num_rows for b in got] == [archives.SENT_ROWS, 300 - archives.SENT_ROWS]


@pytest.mark.parametrize("name, most", [("cyclonedx_components", 4), ("cyclonedx_edges", 4), ("cyclonedx_vulnerabilities", 4), ("spdx_packages", 4)])
def test_documents_are_made_where_their_project_lies(spark, name, most):
    """dependencies by project, by package and by project again, advisories by package; nothing else is shuffled."""
    assert plan(registry.QUERIES[name](spark, SF)).count("Exchange hashpartitioning") <= most


def test_linked_documents_keep_every_link(spark):
    """two packages of one reference, copies, unknown needs and missing values."""
    rows = [("p", "npm", "a", "1", True, ["npm/b@2", "npm/z@0"]), ("p", "npm", "a", "1", False, None), ("p", "npm", "b", "2", False, ["npm/a@1", "npm/b@2"]), ("q", "npm", "b", "2", None, ["npm/a@1"]), ("q", None, "n", "1", True, ["npm/b@2"])]
    deps = spark.createDataFrame(rows, "project string, ecosystem string, name string, version string, direct boolean, depends_on array<string>")
    adv = spark.createDataFrame([("npm", "a", "C-2", "HIGH"), ("npm", "a", "C-1", "low"), ("npm", "y", "C-3", "low")], "ecosystem string, name string, id string, severity string")
    got = {r["project"]: json.loads(r["document"]) for r in RP.cyclonedx(deps, adv, "project", "t", "s").collect()}
    assert [c["scope"] for c in got["p"]["components"]] == ["optional", "required", "optional"] and len(got["q"]["components"]) == 2
    assert [(d["ref"], d["dependsOn"]) for d in got["p"]["dependencies"]] == [("root", ["pkg:npm/a@1"]), ("pkg:npm/a@1", ["pkg:npm/b@2"]), ("pkg:npm/b@2", ["pkg:npm/a@1", "pkg:npm/b@2"])]
    assert [(v["id"], v["ratings"][0]["severity"]) for v in got["p"]["vulnerabilities"]] == [("C-1", "low"), ("C-2", "high")] and "vulnerabilities" not in got["q"]


def test_rounds_of_reaching_are_not_shuffled_again(spark):
    """what was reached in earlier rounds and the calls lie in buckets; only new pairs and the frontier move."""
    pairs = [[("m", "s", f"f{i}")] for i in range(6)]
    rounds = [shared.write_buckets(spark.createDataFrame(p, "module string, symbol string, function string"), "rounds", ["module", "symbol", "function"]) for p in pairs]
    named = shared.write_buckets(spark.createDataFrame([("g", "f5"), ("f0", "f5")], "caller string, callee string"), "calls", ["callee"])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        new = reach._unseen(named, rounds[-1], rounds)
        assert plan(new).count("Exchange hashpartitioning") == 2
        assert [tuple(r) for r in new.collect()] == [("m", "s", "g")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for t in (*rounds, named):
            shared.drop_buckets(t)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("rounds_", "calls_"))]


def test_versions_are_dealt_once_and_by_the_input(spark):
    """one shuffle, of as many tasks as the input's partitions ask for, before versions are parsed or gathered."""
    text = plan(registry.QUERIES["version_order"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in text
    assert shared.spread(spark.range(100).repartition(5), "id", each=16).rdd.getNumPartitions() == 80


def test_lockfile_edges_are_made_where_their_file_lies(spark):
    """the query deals items once, packs files once, and its edges are dealt by file once."""
    assert plan(registry.QUERIES["npm_depends_on"](spark, SF)).count("Exchange hashpartitioning") == 2


def test_lockfile_edges_of_copies(spark):
    """a name stands for its shallowest copy, copies of one version for the shallowest, unknown names for nothing."""
    packages = {"": {"version": "0"}, "node_modules/a": {"version": "1", "dependencies": {"b": "*", "none": "*"}}, "node_modules/b": {"version": "2"}, "node_modules/a/node_modules/b": {"version": "3", "dependencies": {"a": "*"}},
                "node_modules/b/node_modules/a": {"version": "1", "dependencies": {"a": "*"}}}
    files = spark.createDataFrame([("x/package-lock.json", json.dumps({"packages": packages})), ("y/package-lock.json", "{}")], "path string, text string")
    assert sorted(tuple(r) for r in lockfiles.npm_edges(files).collect()) == [("x/package-lock.json", "a", "1", ["npm/b@2"]), ("x/package-lock.json", "b", "3", ["npm/a@1"])]
