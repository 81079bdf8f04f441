"""Masks of sources, names that imports bind, scopes, and the closure over many symbols."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.functions import lexer, uses
from plumbline.operators import analysis, reach
from plumbline.plans.code_queries import SNIPPETS

# language, source, what is left without comments and the insides of strings
BARE = [
    ("js", "a = /* x */ \"b'c\" + `t${f({a: 'q'})}u` / 2; // e", "a =         \"   \" + ` ${f({a: ' '})} ` / 2;     "), ("js", "x = y / 2 / z; r = /a\"[/]b/g.test(q)", "x = y / 2 / z; r = /      /g.test(q)"),
    ("js", "return /x(/.y\nz = a\n/ b", "return /  /.y\nz = a\n/ b"), ("js", "'open\nf()", "'    \nf()"), ("js", "`a${`b${c}`}d` // e", "` ${` ${c}`} `     "), ("rust", "let s = r#\"a \"q\" b\"#; /* a /* b */ c */ f::<'a>('\"', b'\\'')", "let s = r#\"       \"#;                   f::<'a>('\"', b'\\'')"),
    ("py", "s = '''x\n\"y\"''' # z\nf'#'", "s = ''' \n   '''    \nf' '"), ("go", "a := `\\` + \"\\\"\" // c", "a := ` ` + \"  \"     "), ("cpp", "R\"x(a )\" b)x\" 1'000 '\"' // c", "R\"x(      )x\" 1'000 '\"'     "),
    ("php", "<b> \"<?php f(\"x ?>\") # c ?> t' <?= $y", "     <?php f(\"    \")     ?>    <?= $y"), ("ruby", "f(<<~A, <<~B) # c\n one\nA\n two #{x}\nB\ng", "f(<<~A, <<~B)    \n    \nA\n         \nB\ng"),
    ("ruby", "=begin\nx\n=end\n\"a #{b \"c\"} d\"", "      \n \n    \n\"  #{b \" \"}  \""), ("haskell", "{- a {- b -} c -} f' \"s\" -- t\nx --> y", "                  f' \" \"     \nx --> y"), ("lua", "s = [=[ a ]] ]=] --[[ c\n]] f() -- g", "s = [=[      ]=]       \n   f()     "),
    ("bash", "cat <<E | sh # c\n x\nE\na#b \"$(f \"g\")\" '\\' # d", "cat <<E | sh    \n  \nE\na#b \"$(f \" \")\" ' '    "), ("swift", "\"x \\(f(\"y\")) z\" /* /* */ */ #\"q \" r\"#", "\"  \\(f(\" \"))  \"             #\"     \"#"),
    ("c#", "$\"a {F(\"x\")} {{b}}\" + @\"c:\\\" + \"\"\"q \" r\"\"\"", "$\"  {F(\" \")}      \" + @\"   \" + \"\"\"     \"\"\""), ("kotlin", "\"\"\"a ${b(\"c\")} \" d\"\"\" /* /* */ */ e", "\"\"\"  ${b(\" \")}    \"\"\"             e"), ("elixir", "~S(a) \"b #{c} d\" # e", "~S( ) \"  #{c}  \"    "),
    ("java", "\"\"\"\na \" b\n\"\"\" + '\"' // c", "\"\"\"\n     \n\"\"\" + '\"'     "), ("dart", "r'a\\' + '${f('b')} c' /* /* */ */", "r'  ' + '${f(' ')}  '            "), ("gleam", "\"a // b\" // c", "\"      \"     "), ("c", "'\"' \"a\\\"\" /* b", "'\"' \"   \"     "),
]


@pytest.mark.parametrize("language,text,bare", BARE)
def test_what_is_left_of_a_source(language, text, bare):
    assert lexer.masked(text, language)[1] == bare


PIECES = ["\"", "'", "`", "/*", "*/", "//", "#", "--", "{-", "-}", "\n", "\\", "${", "#{", "}", "{", "(", ")", "<<A", "A", "r#\"", "\"#", "'''", '"""', "<?php", "?>", "[[", "]]", "é", "😀", " ", "x", "/", "=begin", "=end", "@\"", "R\"x(", ")x\""]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(lexer.LANGUAGES)), st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_masks_keep_lengths_and_lines_and_lexing_ends(language, text):
    spans = lexer.spans(text, language)
    assert all(a < b for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    code, bare = lexer.masked(text, language)
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    for mask in (code, bare):
        assert len(mask) == len(text) and [i for i, c in enumerate(mask) if c == "\n"] == breaks
        assert all(a == b or a == " " for a, b in zip(mask, text, strict=True))
    uses.uses(language, code, bare, lexer.outer(bare))


def test_every_scanned_language_has_a_lexer():
    assert set(SNIPPETS) | {"cocoapods"} == set(lexer.LANGUAGES)


def test_long_and_deep_sources_end_soon():
    for language in lexer.LANGUAGES:
        for text in ("/*" * 20000, "{-" * 20000, "`${" * 20000, "(" * 50000, "f(" * 20000 + ")" * 20000, "\"" * 30001, "x\n" * 50000, "<<A\n" * 2000):
            lexer.masked(text, language)
    assert uses.uses("js", "f(" * 5000, "f(" * 5000, None)


def test_use_trees_of_rust():
    assert uses.rust_paths("a::{b, c::{d, e as f}, g::*}") == [("a::b", None), ("a::c::d", None), ("a::c::e", "f"), ("a::g::*", None)]
    assert uses.rust_paths("{a::b,c}") == [("a::b", None), ("c", None)] and uses.rust_paths("x::y as z") == [("x::y", "z")] and uses.rust_paths("") == []
    assert uses.rust_paths("a::}{b") and len(uses.rust_paths("a::" + "{" * 100000 + "b" + "}" * 100000)) == 1
    assert [uses.rust_dep_key(x) for x in ("serde::de", "::x::y", "crate::a", "{a, b}", "std::fs")] == ["serde", "x", "", "", ""]


def test_imports_of_odd_sources(spark):
    rows = [("a.py", None), ("b.rs", ""), ("c.js", "require(`a${b}`); require('k'); x.require('no'); import('') "), ("d.go", 'import "fmt"\nimport (\n)'), ("e.php", "no code: use A\\B;"), ("f.cs", "using var x = y; global using A.B;"), ("g.java", "import a.B; // import c.D;"), ("h.txt", "import x")]
    got = {}
    for r in analysis.file_imports(spark.createDataFrame(rows, "path string, body string")).collect():
        got.setdefault(r["path"], set()).add((r["module"], r["key_of"]))
    assert got == {"c.js": {("k", "k"), ("", "")}, "d.go": {("fmt", "fmt")}, "f.cs": {("A.B", "A.B")}, "g.java": {("a.B", "a.B")}}
    keys = {(r["language"], r["dep_key"]) for r in reach.import_keys(analysis.file_imports(spark.createDataFrame([("a.java", "import static p.q.R.m; import s.t.*; import java.util.List;"), ("b.cs", "using static System.Math; using Newtonsoft.Json;"), ("c.rs", "use {a::b, c}; use d::{e};")], "path string, body string"))).collect()}
    assert keys == {("java", "p.q"), ("java", "s.t"), ("c#", "System"), ("c#", "Newtonsoft.Json"), ("rust", "d")}


def test_many_symbols_are_followed_at_once(spark):
    rng = random.Random(4)
    edges = [(f"file{rng.randrange(5)}", f"f{rng.randrange(60)}", f"f{rng.randrange(60)}") for _ in range(90)] + [("file0", f"g{i}", f"g{i + 1}") for i in range(40)] + [("file1", "g40", "g0"), ("file2", None, "g3"), ("file0", "g0", "g1")]
    sites = [(f"file{rng.randrange(5)}", f"f{rng.randrange(60)}", f"m{rng.randrange(3)}", f"s{rng.randrange(4)}", rng.randrange(1, 99)) for _ in range(25)] + [("file9", "g40", "m", "deep", 7), ("file9", "g40", "m", "deep", 3)]
    want = {}
    for label in {(m, s) for _, _, m, s, _ in sites}:
        entries, frontier, names = {}, [], set()
        for file, function, m, s, line in sites:
            if (m, s) == label:
                entries[file, function] = min(entries.get((file, function), line), line)
                frontier.append(function)
                names.add(function)
        while frontier:
            callee = frontier.pop()
            for file, caller, to in edges:
                if to == callee:
                    entries.setdefault((file, caller), None)
                    if caller is not None and caller not in names:
                        names.add(caller)
                        frontier.append(caller)
        for (file, function), line in entries.items():
            want[(*label, file, function)] = (line or 0, line is not None)
    frames = spark.createDataFrame(sites, "file string, function string, module string, symbol string, line long"), spark.createDataFrame(edges, "file string, caller string, callee string")
    got = {(r["module"], r["symbol"], r["file"], r["function"]): (r["line"], r["direct"]) for r in reach.functions_reaching_transitive(*frames).collect()}
    assert got == want
    one = reach.functions_reaching_transitive(*frames, spark.createDataFrame([("m", "deep"), ("m", "none")], "module string, symbol string")).collect()
    assert {(r["module"], r["symbol"]) for r in one} == {("m", "deep")} and len(one) == sum(k[1] == "deep" for k in want)
