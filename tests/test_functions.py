from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import rules as R
from plumbline.functions import scoring as S
from plumbline.functions import versions as V


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(*columns).collect()]


def test_version_order(spark):
    rising = ["0.0.1", "1.0.0-1", "1.0.0-2", "1.0.0-a", "1.0.0-a.1", "1.0.0-a.b", "1.0.0-b", "1.0.0", "1.0.1", "1.2.3-rc.1", "1.2.3", "1.10.0", "2", "18446744073709551615.0.0"]
    pairs = list(zip(rising, rising[1:]))
    assert all(r[0] for r in values(spark, pairs, "a string, b string", V.parse_version(F.col("a")) < V.parse_version(F.col("b"))))
    same = [("v1", "1.0.0"), ("1.0.0+b", "1.0.0"), (" V1.2 ", "1.2.0"), ("1.x", "1.0")]
    assert all(r[0] for r in values(spark, same, "a string, b string", V.parse_version(F.col("a")) == V.parse_version(F.col("b"))))
    bad = [("1.2.3.4",), ("",), ("a.b",), ("1..2",), ("18446744073709551616",), (None,), ("1.2\n",)]
    got = values(spark, bad, "a string", V.parse_version(F.col("a")).isNull())
    assert [r[0] for r in got] == [True] * 6 + [False]


@pytest.mark.parametrize(
    "text,inside,outside",
    [
        ("^1.2.3", ["1.2.3", "1.9.9", "2.0.0-beta"], ["1.2.2", "2.0.0", "1.2.3-rc"]), ("^0.2.3", ["0.2.3", "0.2.9"], ["0.3.0"]), ("^0.0.3", ["0.0.3"], ["0.0.4"]),
        ("^0", ["0.9.9"], ["1.0.0"]), ("^0.0", ["0.0.9"], ["0.1.0"]), ("~1.2", ["1.2.0", "1.2.9"], ["1.3.0"]), ("~1", ["1.9.0"], ["2.0.0"]), ("1.x", ["1.5.0"], ["2.0.0"]),
        ("1.2.3", ["1.2.3"], ["1.2.4"]), (">=1 <2 || 3", ["1.5.0", "3.1.0"], ["2.0.0", "4.0.0"]), (">=1.0, <2", ["1.0.0"], ["2.0.0"]), ("> 1.0", [], ["2.0.0"]), ("1 - 2", [], ["1.5.0"]),
        ("", ["9.9.9", "odd"], []), ("*", ["1.0.0"], []), ("x", ["1.0.0"], ["odd"]), ("!=1.0.0", ["1.0.1"], ["1.0.0"]), ("|| 1", ["7.0.0"], []),
    ],
)
def test_ranges(spark, text, inside, outside):
    rows = [(text, v) for v in inside + outside]
    got = values(spark, rows, "r string, v string", V.version_satisfies(F.col("r"), F.col("v")))
    assert [r[0] for r in got] == [True] * len(inside) + [False] * len(outside)


def test_newer_and_patch_steps(spark):
    got = values(spark, [("1.2.4", "1.2.3"), ("1.2.3", "1.2.3"), ("1.0.0.10", "1.0.0.9"), ("1.0.0.0.1", "1.0.0.0")], "a string, b string", V.newer(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == [True, False, True, True]
    got = values(spark, [("1.2.3", "1.2.4"), ("1.2.3", "1.3.0"), ("1.2", "1.2.1")], "a string, b string", V.is_patch_step(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == [True, False, False]
    assert values(spark, [("My_.Pkg--x",)], "a string", V.normalize_pypi(F.col("a"))) == [("my-pkg-x",)]


def test_verdicts_and_severities(spark):
    got = values(spark, [(s,) for s in (20, 21, 60, 61, 99, 100)], "s int", S.verdict_name(S.score_verdict(F.col("s"))))
    assert [r[0] for r in got] == ["safe", "review", "review", "prompt", "prompt", "block"]
    got = values(spark, [(s,) for s in ("MODERATE", "High", "critical", "low", "info", "odd", None)], "s string", S.severity_rank(F.col("s")))
    assert [r[0] for r in got] == [2, 3, 4, 1, 0, 0, 0]


def test_cvss(spark):
    vectors = [
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N", None), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H", None), ("CVSS:3.1/AV:Q/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None), (None, None),
    ]
    got = values(spark, [(v,) for v, _ in vectors], "v string", S.cvss_base_score(F.col("v")))
    assert [r[0] for r in got] == [s for _, s in vectors]


def test_dep_keys(spark):
    rows = [("js", "@scope/pkg/sub", "@scope/pkg"), ("js", "node:fs", ""), ("js", "./x", ""), ("js", "lodash/fp", "lodash"), ("go", "encoding/json", ""), ("rust", "serde::de", "serde"), ("rust", "std::io", ""), ("java", "java.util.List", ""), ("py", "yaml.nodes", "yaml"), ("php", "A\\B", ""), ("ruby", "rack/utils", "rack")]
    got = values(spark, [r[:2] for r in rows], "l string, m string", N.dep_key(F.col("l"), F.col("m")))
    assert [r[0] for r in got] == [r[2] for r in rows]


def test_globs_paths_and_references(spark):
    rows = [("*.js", "a/b.js", False), ("*.js", "b.js", True), ("lib/**", "lib/x", True), ("lib/**", "lib/x/y", False), ("a+(b).js", "a+(b).js", True), ("a.js", "axjs", False)]
    assert [r[0] for r in values(spark, [r[:2] for r in rows], "g string, p string", N.glob_match(F.col("p"), F.col("g")))] == [r[2] for r in rows]
    assert [r[0] for r in values(spark, [("a\\b/./c//../d",), ("../../x",), ("",)], "p string", N.clean_path(F.col("p")))] == ["a/b/d", "x", ""]
    got = values(spark, [("nginx",), ("a/b:1",), ("h.io/x@sha256:0",), ("localhost/y",), ("h:5000/a/b:t",)], "r string", N.image_reference(F.col("r")).alias("x"))
    assert [tuple(r[0]) for r in got] == [("registry-1.docker.io", "library/nginx", "latest"), ("registry-1.docker.io", "a/b", "1"), ("h.io", "x", "latest"), ("localhost", "y", "latest"), ("h:5000", "a/b", "t")]


def test_names_and_specs(spark):
    got = values(spark, [("npm", "@a/b c", "1.0~x+y"), ("maven", "g:a", "1"), ("crates", "x", "")], "e string, n string, v string", N.purl(F.col("e"), F.col("n"), F.col("v")))
    assert [r[0] for r in got] == ["pkg:npm/%40a/b%20c@1.0~x%2By", "pkg:maven/g/a@1", "pkg:cargo/x"]
    got = values(spark, [("@s/p@^1",), ("p@1.0",), ("p",), ("@s/p",)], "s string", N.npm_spec(F.col("s")))
    assert [tuple(r[0]) for r in got] == [("@s/p", "^1"), ("p", "1.0"), ("p", ""), ("@s/p", "")]
    got = values(spark, [("requests[socks]>=2.0 ; python_version<'3'",), ("a (==1)",), ("b",)], "s string", N.pep508_spec(F.col("s")))
    assert [tuple(r[0]) for r in got] == [("requests", ">=2.0"), ("a", "==1"), ("b", "")]
    got = values(spark, [("git+https://github.com/a/b.git",), ("github:a/b",), ("a/b",), ("git@github.com:a/b.git",), ("https://gitlab.com/a/b",)], "s string", N.parse_repository(F.col("s")))
    assert [r[0] for r in got] == ["a/b", "a/b", "a/b", "a/b", None]


def test_hosts_and_lines(spark):
    rows = [("raw.githubusercontent.com", "t.co", False), ("x.t.co", "t.co", True), ("my-filebin.net", "filebin", True)]
    for host, listed, want in rows:
        assert values(spark, [(host,)], "h string", N.domain_match(F.col("h"), listed)) == [(want,)]
    assert values(spark, [("a\r\nb\n",), ("",), ("a",)], "t string", R.lines(F.col("t"))) == [(["a", "b"],), ([],), (["a"],)]
    assert values(spark, [('"cur" + "l" + "x"',)], "t string", R.join_literals(F.col("t"))) == [('"curlx"',)]


def test_small_batches_bound_rows_and_bytes():
    import pyarrow as pa

    from plumbline.functions.batches import small

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["x" * 2000] * 10_000)], ["n", "t"])
    parts = list(small(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))
    assert [n for p in parts for n in p.column(0).to_pylist()] == [*range(10_000), 0]
    assert max(p.num_rows for p in parts) <= 128 and max(p.nbytes for p in parts) <= 1 << 20
    wide = pa.RecordBatch.from_arrays([pa.array(["y" * (3 << 20)] * 4)], ["t"])
    assert [p.num_rows for p in small([wide])] == [1, 1, 1, 1]


def test_code_facts_are_one_pass_over_texts(spark):
    """Masked texts do not leave the worker that makes them: one Arrow pass, where two sent three masks a file between them."""
    from plumbline.operators import analysis

    facts = analysis.code_facts(spark.createDataFrame([("a.mjs", "f(1)")], "path string, body string"))
    assert facts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(r["kind"], r["symbol"]) for r in facts.collect()] == [("call", "f")]
