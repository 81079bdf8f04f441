"""Queries over sources of all scanned languages: whole documents as comments, then two snippets by id, near misses among them.

What each snippet holds is stated beside it, by hand: its capabilities and its imports (module as written). Symbols, calls
and lines follow from where a document's text puts the code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, reach
from . import derived as D
from .rule_queries import pick, q, sql_list, sql_pick

# language: (extension, comment opening a line), snippets of (code, capabilities, imports)
SNIPPETS: dict[str, tuple[str, str, list[tuple[str, str, list[str]]]]] = {
    "js": ("js", "//", [
        ('const cp = require("child_process");', "shell-spawn", ["child_process"]), ('x = "require(\'child_process\')"; // eval(x)', "", []), ('import { a as b, c } from "@s/p/q";\neval(b)', "dynamic-eval", ["@s/p/q"]),
        ("obj.eval(1); const r = /fetch(x)/;", "", []), ("const t = `eval(1) ${fetch(u)}`;", "net-egress", []), ("import './side'; import('dyn');\nimport * as z from 'z'", "", ["./side", "dyn", "z"]), ("process.env.HOME", "env-read", []), ("`process.env.HOME`", "", []),
    ]),
    "py": ("py", "#", [
        ("import os, sys as z, a.b\nos.system('x')", "shell-spawn", ["os", "sys", "a.b"]), ('s = """\nimport no\nos.system(1)\n"""', "", []), ("from .x import y; from q.r import (s,\n  t)", "", [".x", "q.r"]),
        ("if 1: import lazy\neval('1')", "dynamic-eval", ["lazy"]), ("x.eval(1)\n'importlib.import_module(1)'", "", []), ("importlib.import_module('dyn')\n__import__(\"d2\")", "dynamic-eval", ["dyn", "d2"]),
    ]),
    "go": ("go", "//", [
        ('import (\n\t"os/exec"\n\tc "github.com/a/b" // "no/no"\n)\nvar _ = exec.Command("x")', "shell-spawn", ["os/exec", "github.com/a/b"]), ("import _ `x.y/z`\nvar s = `exec.Command(\"x\")`", "", ["x.y/z"]), ("/* exec.Command() */ var e = myexec.Command(1)", "", []),
    ]),
    "php": ("php", "//", [
        ("use A\\B, C as D; use E\\{F, G\\H as I};\nclass K { use T; }\neval($x);", "dynamic-eval", ["A\\B", "C", "E\\F", "E\\G\\H"]), ("$s = <<<EOT\nuse No; eval(1)\nEOT;\nrequire 'inc.php';", "", ["inc.php"]), ("$o->eval(1); # system(1)\n$s = 'system(1)';", "", []), ("$f = function () use ($a) {};\n$b = base64_decode($x); ?> eval(1) <?php", "base64-decode", []),
    ]),
    "ruby": ("rb", "#", [
        ("require 'net/http'\nsystem('ls')", "shell-spawn", ["net/http"]), ("s = \"system('x')\"\nrequire_relative 'x'", "", ["x"]), ("s = <<~A\n  system('x')\nA\ngem 'rails'", "", ["rails"]), ("t = \"a #{eval(x)}\"\nautoload :X, 'y/z'", "dynamic-eval", ["y/z"]), ("=begin\nsystem('x')\n=end\nobj.system2(1)", "", []),
    ]),
    "rust": ("rs", "//", [
        ("use a::{b, c::{d, e as f}};\nfn m() { std::process::Command::new(\"x\"); }", "shell-spawn", ["a::{b, c::{d, e as f}}"]), ("/* a /* Command::new(1) */ Command::new(2) */ extern crate rand;", "", ["rand"]), ("let s = r#\"Command::new(\"x\")\"#; let c = '\"'; fs::write(a, b);", "fs-write-outside-root", []),
        ("fn f<'a>(x: &'a str) { MyCommand::new(x) } pub use x::y as z;", "", ["x::y as z"]),
    ]),
    "java": ("java", "//", [
        ("import static a.b.C.m;\nimport d.e.*;\nnew ProcessBuilder(x);", "shell-spawn", ["a.b.C.m", "d.e.*"]), ('String s = """\nnew ProcessBuilder(x)\n"""; import f.G;', "", ["f.G"]), ("char c = '\"'; new Socket(h, 1); // \"", "net-egress", []), ("new ProcessBuilderX(1);", "", []),
    ]),
    "c#": ("cs", "//", [
        ("using System.Text;\nusing static A.B;\nusing J = X.Y;\nProcess.Start(x);", "shell-spawn", ["System.Text", "A.B", "X.Y"]), ('var s = @"c:\\"; var t = "Process.Start(1)"; using (x) {}', "", []), ('var s = $"{Convert.FromBase64String(x)} Process.Start(1)";', "base64-decode", []),
    ]),
    "bash": ("sh", "#", [("curl http://x", "net-egress", []), ("echo 'x; curl y '", "", []), ("cat <<EOF\ncurl x\nEOF", "", []), ("x=\"$(\ncurl y)\"", "net-egress", []), ("echo a#b; eval x", "dynamic-eval", []), ("mycurl x", "", [])]),
    "c": ("c", "//", [('system("x");', "shell-spawn", []), ('puts("system(1)"); /* system(2) */', "", []), ("char c = '\"'; fopen(a, b);", "fs-write-outside-root", []), ("mysystem(1); obj.system(1);", "", [])]),
    "cpp": ("cpp", "//", [('auto s = R"x(system("a") )" )x"; int n = 1\'000; dlopen(p);', "dynamic-eval", []), ('auto t = "popen(1)";', "", []), ("socket(1);", "net-egress", [])]),
    "elixir": ("ex", "#", [('System.cmd("x", [])', "shell-spawn", []), ('s = """\nSystem.cmd("x")\n"""', "", []), ('t = "a #{Code.eval_string(x)}"', "dynamic-eval", []), ("~S(System.cmd(1))", "", [])]),
    "kotlin": ("kt", "//", [("rt.exec(x)", "shell-spawn", []), ("/* a /* b */ rt.exec(x) */ f()", "", []), ('val s = """rt.exec(x) ${e.eval(y)}"""', "dynamic-eval", [])]),
    "swift": ("swift", "//", [("system(x)", "shell-spawn", []), ('let s = #"system("x")"#', "", []), ('let t = "a \\(popen(x)) system(y)"', "shell-spawn", []), ("/* /* */ system(x) */", "", [])]),
    "lua": ("lua", "--", [("os.execute(x)", "shell-spawn", []), ("s = [==[ os.execute(x) ]] ]==]", "", []), ("--[[ io.popen(1)\n]] loadstring(x)", "dynamic-eval", []), ("myos.execute2(1)", "", [])]),
    "dart": ("dart", "//", [("Process.run(x);", "shell-spawn", []), ("var s = r'Process.run(x) \\'; var t = \"\"\"Process.run(y)\"\"\";", "", []), ("var u = '${base64Decode(x)}';", "base64-decode", [])]),
    "haskell": ("hs", "--", [("f = callCommand x", "shell-spawn", []), ("{- a {- callCommand -} callCommand -}\ng = foldl' h", "", []), ('s = "callCommand"', "", []), ("x --> unsafePerformIO", "dynamic-eval", [])]),
    "gleam": ("gleam", "//", [("import gleam/http", "net-egress", []), ('let s = "import gleam/http"', "", []), ("@external(erlang)", "dynamic-eval", [])]),
}
LANGUAGES = list(SNIPPETS)


def sources(spark, d):
    """(doc_id, ecosystem, name, version, path, body): the language by id, each line of the text a comment, then two snippets."""
    n = len(LANGUAGES)
    at = F.expr(f"doc_id div {n}")
    lines, first, second, ext = None, None, None, None
    for k, name in enumerate(LANGUAGES):
        extension, comment, snippets = SNIPPETS[name]
        codes = [s[0] for s in snippets]
        told = F.concat(F.lit(comment + " "), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("?>"), F.lit("")), F.lit("\n"), F.lit("\n" + comment + " ")))
        told = F.concat(F.lit("<?php\n"), told) if name == "php" else told
        here = F.col("doc_id") % n == k
        choose = lambda old, new: F.when(here, new) if old is None else old.when(here, new)  # noqa: B023, E731
        lines, first, second, ext = choose(lines, told), choose(first, pick(codes, at)), choose(second, pick(codes, F.expr(f"doc_id div {n * 5} + 1"))), choose(ext, F.lit(extension))
    return D.table(spark, d, "documents").select(
        "doc_id", F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "doc_id").alias("name"), F.lit("1.0.0").alias("version"),
        F.concat(F.lit("d"), "doc_id", F.lit("."), ext).alias("path"), F.concat_ws("\n", lines, first, second, F.lit("")).alias("body"),
    )


def language_capabilities(spark, d):
    """Capabilities of sources in all languages; what stands in comments and strings counts for nothing."""
    return analysis.file_capabilities(sources(spark, d)).select("doc_id", F.explode("capabilities").alias("capability"))


def language_imports(spark, d):
    return analysis.file_imports(sources(spark, d)).select("doc_id", "language", "module").distinct()


def _chosen() -> str:
    n = len(LANGUAGES)
    counts = "[" + ", ".join(str(len(SNIPPETS[x][2])) for x in LANGUAGES) + "]"
    return (
        f"c AS (SELECT doc_id, doc_id % {n} AS k, {counts}[CAST(doc_id % {n} + 1 AS INT)] AS m FROM documents), "
        f"p AS (SELECT DISTINCT doc_id, k, i FROM (SELECT doc_id, k, (doc_id // {n}) % m AS i FROM c UNION ALL SELECT doc_id, k, (doc_id // {n * 5} + 1) % m FROM c))"
    )


def _told(which: int) -> str:
    rows = [(k, i, x) for k, name in enumerate(LANGUAGES) for i, s in enumerate(SNIPPETS[name][2]) for x in ([s[1]] if which == 1 and s[1] else s[2] if which == 2 else [])]
    return "(VALUES " + ", ".join(f"({k}, {i}, {q(x)})" for k, i, x in rows) + ") t(k, i, x)"


# Symbols and calls: code around names that depend on the id, after the text as a comment of as many lines as it has.
JS = """import def, { merge as m, template } from "lodash/fp";
import * as ns from "@s/pkg/x";
const cp = require('child_process'), no = other.require('fs');
// cp.comment()
const s = "cp.string(1)", t = `cp.text(${m(1)})`;
function outer%(a = cp.arg) {
  const inner = () => { cp.exec(1); };
  [1].map(function named() { template(2) });
  ns.go();
}
class K { static run%() { def(); if (cp.kind) { m(3) } new ns.Make() } }
after(cp.last, no.read)
"""
JS_SYMBOLS = [("<module>", "lodash", "merge", 5), ("outer%", "child_process", "arg", 6), ("inner", "child_process", "exec", 7), ("outer%", "lodash", "template", 8), ("outer%", "@s/pkg", "go", 9), ("run%", "lodash", "default", 11), ("run%", "child_process", "kind", 11), ("run%", "lodash", "merge", 11), ("run%", "@s/pkg", "Make", 11), ("<module>", "child_process", "last", 12)]
JS_CALLS = [("<module>", "require", 3), ("<module>", "m", 5), ("inner", "exec", 7), ("outer%", "map", 8), ("outer%", "template", 8), ("outer%", "go", 9), ("run%", "def", 11), ("run%", "m", 11), ("<module>", "after", 12)]
GO = """package m
import (
  "os/exec"
  c "github.com/a/cobra" // "not/this"
  _ "x.y/z"
)
type I interface { Foo(x int) }
var top = c.New()
func (r *R) Run%(x c.Type) (func(), struct{ a int }) {
  go func() { exec.Command("exec.Not()") }()
  return helper(1), nil
}
func main() { r.exec.Field(`c.Raw()`); Run%() }
"""
GO_SYMBOLS = [("<module>", "github.com/a/cobra", "New", 8), ("Run%", "github.com/a/cobra", "Type", 9), ("Run%", "os/exec", "Command", 10)]
GO_CALLS = [("<module>", "New", 8), ("Run%", "Command", 10), ("Run%", "helper", 11), ("main", "Field", 13), ("main", "Run%", 13)]
PHP = """namespace A;
use Foo\\Bar, Foo\\Qux as Q; use Foo\\{One, Two\\Three as T};
class C { use Mixed;
  function run%() {
    Bar::make("Bar::text()"); // Bar::comment()
    $f = function () use ($y) { return Q::CONST; };
    T::$field; new Bar(2); Mixed::no(); \\Ns\\call(1); $o?->method();
  }
}
One::class; helper%();
"""
PHP_SYMBOLS = [("run%", "Foo\\Bar", "make", 5), ("run%", "Foo\\Qux", "CONST", 6), ("<module>", "Foo\\One", "class", 10)]
PHP_CALLS = [("run%", "make", 5), ("run%", "no", 7), ("run%", "call", 7), ("run%", "method", 7), ("<module>", "helper%", 10)]
RUST = """use a::{b, c::{d, e as f}, g::*}; use serde_json::from_str;
use std::fs; use crate::local;
fn main%() {
  b::x(); f::y::z(); d(1);
  from_str::<i32>("b::text()"); // b::comment()
  a::q::r(1); let t: a::Type = 1; fs::write(); local::u(); e(1);
}
"""
RUST_SYMBOLS = [("<module>", "a", "x", 4), ("<module>", "a", "y", 4), ("<module>", "a", "d", 4), ("<module>", "serde_json", "from_str", 5), ("<module>", "a", "q", 6)]
CODE = {"js": (JS, JS_SYMBOLS, JS_CALLS), "go": (GO, GO_SYMBOLS, GO_CALLS), "php": (PHP, PHP_SYMBOLS, PHP_CALLS), "rust": (RUST, RUST_SYMBOLS, [])}


def _facts(spark, d, language: str):
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("")), F.lit("/*"), F.lit(""))
    code = F.replace(F.lit(CODE[language][0]), F.lit("%"), F.expr("cast(doc_id % 7 as string)"))
    body = F.concat(F.lit("<?php " if language == "php" else ""), F.lit("/* "), text, F.lit(" */\n"), code)
    ext = {"js": "mjs", "go": "go", "php": "php", "rust": "rs"}[language]
    return analysis.code_facts(D.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit("." + ext)).alias("path"), body.alias("body")))


def _facts_sql(language: str, which: int) -> str:
    ext = {"js": "mjs", "go": "go", "php": "php", "rust": "rs"}[language]
    told = ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in CODE[language][which])
    names = "function, module, symbol, k" if which == 1 else "caller, callee, k"
    at = lambda c: f"replace({c}, '%', CAST(doc_id % 7 AS VARCHAR)) AS {c}"
    rows = f"{at('function')}, module, symbol, CAST(n + k AS BIGINT) AS line" if which == 1 else f"{at('caller')}, {at('callee')}"
    lines = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1"
    return f"SELECT 'd' || doc_id || '.{ext}' AS file, {rows} FROM (SELECT doc_id, {lines} AS n FROM documents), (VALUES {told}) t({names})"


def _symbols(language: str):
    def run(spark, d):
        return analysis.symbol_sites(_facts(spark, d, language)).select("file", "function", "module", "symbol", "line")

    run.__name__ = f"{language}_symbols"
    return run


def _calls(language: str):
    def run(spark, d):
        return analysis.call_edges(_facts(spark, d, language)).select("file", "caller", "callee")

    run.__name__ = f"{language}_calls"
    return run


def reaching_many(spark, d):
    """Which functions reach each of thousands of symbols, through calls that form trees with cycles among them."""
    orders = D.table(spark, d, "orders")
    file, name = F.concat(F.lit("file"), F.col("o_custkey") % 50), lambda e: F.concat(F.lit("f"), F.expr(e))
    edges = orders.select(file.alias("file"), name("o_orderkey").alias("caller"), name("o_orderkey div 3").alias("callee"))
    back = orders.where("o_orderkey % 97 = 0").select(file.alias("file"), name("o_orderkey div 9").alias("caller"), name("o_orderkey").alias("callee"))
    sites = orders.where("o_orderkey % 5 = 0").select(
        file.alias("file"), name("o_orderkey div 2").alias("function"), F.concat(F.lit("m"), F.col("o_custkey") % 7).alias("module"), F.concat(F.lit("s"), F.col("o_orderkey") % 1501).alias("symbol"), F.col("o_orderkey").cast("long").alias("line"),
    )
    return reach.functions_reaching_transitive(sites, edges.unionByName(back))


_REACHING = """WITH RECURSIVE e AS (SELECT DISTINCT 'file' || (o_custkey % 50) AS file, 'f' || o_orderkey AS caller, 'f' || (o_orderkey // 3) AS callee FROM orders
  UNION SELECT 'file' || (o_custkey % 50), 'f' || (o_orderkey // 9), 'f' || o_orderkey FROM orders WHERE o_orderkey % 97 = 0),
d AS (SELECT 'm' || (o_custkey % 7) AS module, 's' || (o_orderkey % 1501) AS symbol, 'file' || (o_custkey % 50) AS file, 'f' || (o_orderkey // 2) AS function, CAST(min(o_orderkey) AS BIGINT) AS line
  FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1, 2, 3, 4),
r AS (SELECT module, symbol, function FROM d UNION SELECT r.module, r.symbol, e.caller FROM r JOIN e ON e.callee = r.function),
a AS (SELECT module, symbol, file, function, line FROM d UNION ALL SELECT r.module, r.symbol, e.file, e.caller, NULL FROM r JOIN e ON e.callee = r.function)
SELECT module, symbol, file, function, coalesce(min(line), 0) AS line, min(line) IS NOT NULL AS direct FROM a GROUP BY 1, 2, 3, 4"""

NAMES = [language_capabilities, language_imports, *map(_symbols, CODE), *map(_calls, ("js", "go", "php")), reaching_many]
QUERIES = {f.__name__: f for f in NAMES}
ORACLES = {
    "language_capabilities": f"WITH {_chosen()} SELECT DISTINCT doc_id, x AS capability FROM p JOIN {_told(1)} USING (k, i)",
    "language_imports": f"WITH {_chosen()} SELECT DISTINCT doc_id, {sql_pick(LANGUAGES, 'k')} AS language, x AS module FROM p JOIN {_told(2)} USING (k, i)",
    "reaching_many": _REACHING,
    **{f"{x}_symbols": _facts_sql(x, 1) for x in CODE}, **{f"{x}_calls": _facts_sql(x, 2) for x in ("js", "go", "php")},
}
del sql_list
