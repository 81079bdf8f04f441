"""Which imported symbols a source uses, in which function, and which function calls which, from the tokens of masked texts.

Names that imports bind hold for the whole file. Scopes are a stack over brackets: a named function (by its declaration, as a
method, or by the variable that it is assigned to) opens one, an unnamed one belongs to the scope around it, and code
outside all is ``<module>``. Rows are (kind symbol or call, function, module, symbol or callee, line).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from .lexer import Lines

MODULE = "<module>"
_TOKEN = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$]*|\d[\w.]*|=>|\?->|->|\?\.|::|&&|\|\||\?\?|==+|!=+|<=|>=|\.\.\.|[^\s\w]")
_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$]*\Z")
_PAIR = {"(": ")", "[": "]", "{": "}"}
_QUOTES = "\"'`"


@dataclass
class Tokens:
    """Tokens of a bare text, with the partners of brackets; strings are a token by their opening quote."""

    word: list[str]
    at: list[int]
    partner: dict[int, int]
    line: Lines

    @classmethod
    def of(cls, bare: str) -> Tokens:
        word, at, partner, open_, skip = [], [], {}, [], -1
        for m in _TOKEN.finditer(bare):
            if m.start() < skip:
                continue
            w = m[0]
            if w in _PAIR:
                open_.append(len(word))
            elif w in ")]}":
                while open_ and _PAIR[word[open_[-1]]] != w and len(open_) > 1 and any(_PAIR[word[k]] == w for k in open_):
                    open_.pop()
                if open_ and _PAIR[word[open_[-1]]] == w:
                    partner[open_[-1]] = len(word)
                    partner[len(word)] = open_.pop()
            word.append(w)
            at.append(m.start())
        return cls(word, at, partner, Lines(bare))

    def get(self, k: int) -> str:
        return self.word[k] if 0 <= k < len(self.word) else ""

    def is_name(self, k: int) -> bool:
        return bool(_NAME.match(self.get(k)))

    def same_line(self, a: int, b: int) -> bool:
        return self.line.of(self.at[a]) == self.line.of(self.at[b])


class _Scopes:
    """Named scopes as (first token, last token, name); tokens are asked for in order."""

    def __init__(self, found: list[tuple[int, int, str]]):
        self.left, self.open = sorted(found, key=lambda s: (s[0], -s[1])), []
        self.next = 0

    def at(self, k: int) -> str:
        while self.next < len(self.left) and self.left[self.next][0] <= k:
            self.open.append(self.left[self.next])
            self.next += 1
        while self.open and self.open[-1][1] < k:
            self.open.pop()
        return self.open[-1][2] if self.open else MODULE


def _body_end(t: Tokens, k: int) -> int:
    """The last token of a function whose parameters open at ``k``: the end of its body, or a semicolon if it has none."""
    k = t.partner.get(k, k) + 1
    while k < len(t.word) and t.word[k] not in ("{", ";"):
        k = t.partner.get(k, k) + 1 if t.word[k] in _PAIR else k + 1
    return t.partner.get(k, len(t.word)) if t.get(k) == "{" else k


# JavaScript

# Words and signs after which ``function`` is part of an expression.
_JS_VALUE = set("( , = : [ ! & | ? + - * / % ~ ^ < > => && || ?? == === != !== <= >= ...".split()) | {"return", "typeof", "new", "void", "in", "of", "case", "yield", "await", "throw", "delete", "instanceof"}
_JS_WORDS = {"if", "for", "while", "switch", "catch", "with", "return", "typeof", "await", "function", "super", "import", "in", "of", "void", "delete", "throw", "new", "else", "do", "case", "yield", "instanceof", "class", "const", "let", "var", "async", "static"}


def js_dep_key(module: str) -> str:
    if not module or module.startswith(("./", "../", "/", "node:")) or module in (".", ".."):
        return ""
    parts = module.split("/")
    return "/".join(parts[:2]) if module.startswith("@") else parts[0]


_JS_IMPORT = re.compile(r"""(?<![.\w$])import\s*([\w$*{},\s]*?)\s*\bfrom\s*['"]([^'"\n]*)['"]""")
_JS_REQUIRE = re.compile(r"""([A-Za-z_$][\w$]*)\s*=\s*require\s*\(\s*['"`]([^'"`\n]*)['"`]\s*[,)]""")


def _js_bindings(code: str, declared: set[int]) -> dict[str, tuple[str, str]]:
    """Local name to (module, symbol); ``*`` for a whole module. ``declared`` has the positions of declared variables."""
    found: list[tuple[int, str, tuple[str, str]]] = []
    for m in _JS_IMPORT.finditer(code):
        module = js_dep_key(m[2]) or m[2]
        named = re.search(r"\{([^}]*)\}", m[1])
        for part in (named[1] if named else "").split(","):
            name, _, alias = (x.strip() for x in re.sub(r"\s+as\s+", "\x00", part.strip()).partition("\x00"))
            if name:
                found.append((m.start(), alias or name, (module, name)))
        rest = re.sub(r"\{[^}]*\}", "", m[1])
        for part in (x.strip() for x in rest.split(",")):
            star = re.fullmatch(r"\*\s*as\s+([\w$]+)", part)
            if star:
                found.append((m.start(), star[1], (module, "*")))
            elif _NAME.match(part):
                found.append((m.start(), part, (module, "default")))
    for m in _JS_REQUIRE.finditer(code):
        if m.start() in declared and "${" not in m[2] and re.match(r"\s*(?:[;,)\n}]|$|//|const\b|let\b|var\b)", code[m.end() :] if code[m.end() - 1] == ")" else ";"):
            found.append((m.start(), m[1], (js_dep_key(m[2]) or m[2], "*")))
    return {name: of for _, name, of in sorted(found, key=lambda f: f[0])}


def _js_value_end(t: Tokens, k: int) -> int:
    """The last token of an arrow function's body that begins at ``k``."""
    if t.get(k) == "{":
        return t.partner.get(k, len(t.word))
    first = k
    while k < len(t.word):
        w = t.word[k]
        if w in (";", ",") or w in ")]}":
            return k - 1
        if k > first and not t.same_line(k - 1, k) and (t.is_name(k) and w not in ("in", "of", "instanceof") or w in _QUOTES) and (t.is_name(k - 1) or t.word[k - 1] in ")]}" or t.word[k - 1] in _QUOTES):
            return k - 1
        k = t.partner.get(k, k) + 1 if w in _PAIR else k + 1
    return k


def _js_scopes(t: Tokens) -> tuple[list[tuple[int, int, str]], set[int], set[int]]:
    """Scopes, the tokens that name a function where it is defined, and those that name a declared variable."""
    scopes, defined, declared, objects = [], set(), set(), set()
    classes, declaring = set(), []  # declaring: for each open bracket, whether its level declares variables
    level: list[bool] = [False]
    for k, w in enumerate(t.word):
        before = t.get(k - 1)
        if w in _PAIR:
            if w == "{" and before in _JS_VALUE and before != "=>":
                objects.add(k)
            level.append(False)
            declaring.append(k)
        elif w in ")]}":
            if declaring:
                declaring.pop()
                level.pop()
        elif w in ("const", "let", "var") and before != ".":
            level[-1] = True
        elif w == ";" or (level[-1] and t.is_name(k) and k and not t.same_line(k - 1, k) and before not in _JS_VALUE and not level[-1] is None and before not in ("const", "let", "var", "async", "function", ",")):
            level[-1] = False
        if w == "class" and before != ".":
            j = k + 1
            while j < len(t.word) and t.word[j] not in ("{", ";"):
                j = t.partner.get(j, j) + 1 if t.word[j] in "([" else j + 1
            classes.add(j)
        if w == "function" and before != ".":
            j = k + 1 + (t.get(k + 1) == "*")
            if t.is_name(j) and t.get(j + 1) == "(":
                defined.add(j)
                lead = t.get(k - 2) if before == "async" else before
                if lead not in _JS_VALUE:
                    scopes.append((k, _body_end(t, j + 1), t.word[j]))
            elif t.get(j) == "(":
                defined.add(k)
        inside = declaring[-1] if declaring and w not in _PAIR else (declaring[-2] if len(declaring) > 1 else None)
        if t.is_name(k) and t.get(k + 1) == "(" and inside in (classes | objects) and w != "function":
            lead = before
            if lead in ("{", "}", ";", ",", "static", "async", "get", "set", "*", "#") or (inside in classes and not t.same_line(k - 1, k)):
                close = t.partner.get(k + 1)
                if close and t.get(close + 1) == "{" and (inside in classes or lead in ("{", ",", "async", "get", "set", "*")):
                    defined.add(k)
                    scopes.append((k, _body_end(t, k + 1), ("#" if lead == "#" else "") + w))
        if level[-1] and t.is_name(k) and t.get(k + 1) == "=" and before in ("const", "let", "var", ","):
            declared.add(t.at[k])
            j = k + 2 + (t.get(k + 2) == "async")
            if t.get(j) == "function" and t.get(j + 1) != "*":
                opens = j + 1 + t.is_name(j + 1)
                if t.get(opens) == "(":
                    scopes.append((j, _body_end(t, opens), w))
            else:
                arrow = t.partner.get(j, j) + 1 if t.get(j) == "(" else j + 1 if t.is_name(j) else -1
                if t.get(arrow) == "=>":
                    scopes.append((j, _js_value_end(t, arrow + 1), w))
    return scopes, defined, declared


def js_uses(code: str, bare: str) -> Iterator[tuple[str, str, str, str, int]]:
    t = Tokens.of(bare)
    found, defined, declared = _js_scopes(t)
    bound, scopes = _js_bindings(code, declared), _Scopes(found)
    built: set[int] = set()  # names of constructors
    imports = {m.start(): m.end() for m in _JS_IMPORT.finditer(code)}
    until = -1
    for k, w in enumerate(t.word):
        until = imports.get(t.at[k], until) if w == "import" else until
        function = scopes.at(k)
        if t.at[k] < until or not t.is_name(k):
            continue
        before, after = t.get(k - 1), t.get(k + 1)
        member = before in (".", "?.")
        if before == "new" or (member and k - 2 in built):
            built.add(k)
        called = after == "(" or after == "`" or (after == "?." and t.get(k + 2) == "(")
        line = t.line.of(t.at[k])
        if not member and w in bound and after in (".", "?.") and (t.is_name(k + 2) or t.get(k + 2) == "#"):
            yield "symbol", function, bound[w][0], t.get(k + 2), t.line.of(t.at[k + 2])
        if called and k not in defined and k not in built and (member or w not in _JS_WORDS):
            if not member and w in bound and bound[w][1] != "*":
                yield "symbol", function, *bound[w], line
            yield "call", function, "", w, line


# Go

_GO_SPEC = re.compile(r"""(?:(?P<alias>[\w.]+)[ \t]+)?["`](?P<path>[^"`\n]*)["`]""")
_GO_WORDS = {"func", "if", "for", "switch", "select", "return", "go", "defer", "case", "range", "type", "struct", "interface", "map", "chan", "var", "const", "import", "package", "else"}


def go_dep_key(path: str) -> str:
    return path if "." in path.split("/")[0] else ""


def _go_imports(code: str) -> Iterator[tuple[int, int]]:
    """Stretches of import declarations."""
    for m in re.finditer(r"""(?m)^[ \t]*import\s*(\([^)]*\)|(?:[\w.]+\s+)?["`][^"`\n]*["`])""", code):
        yield m.start(1), m.end(1)


def go_uses(code: str, bare: str) -> Iterator[tuple[str, str, str, str, int]]:
    bound: dict[str, str] = {}
    stretches = list(_go_imports(code))
    for a, b in stretches:
        for m in _GO_SPEC.finditer(code, a, b):
            local = m["alias"] or m["path"].rsplit("/", 1)[-1]
            if local not in (".", "_"):
                bound[local] = m["path"]
    t = Tokens.of(bare)
    found, named, shapes = [], set(), []
    for k, w in enumerate(t.word):
        if w == "func":
            j = t.partner.get(k + 1, k) + 1 if t.get(k + 1) == "(" and t.is_name(t.partner.get(k + 1, k) + 1) and t.get(t.partner.get(k + 1, k) + 2) in ("(", "[") else k + 1
            if t.is_name(j) and t.get(j + 1) in ("(", "["):
                named.add(j)
                opens = j + 1 if t.get(j + 1) == "(" else t.partner.get(j + 1, j) + 1
                found.append((k, _go_end(t, opens), t.word[j]))
        elif w == "interface" and t.get(k + 1) == "{":
            shapes.append((k + 1, t.partner.get(k + 1, k + 1)))
    scopes, at = _Scopes(found), 0
    for k, w in enumerate(t.word):
        function = scopes.at(k)
        while at < len(stretches) and stretches[at][1] <= t.at[k]:
            at += 1
        if not t.is_name(k) or (at < len(stretches) and stretches[at][0] <= t.at[k]):
            continue
        before, after = t.get(k - 1), t.get(k + 1)
        if before != "." and w in bound and after == "." and t.is_name(k + 2):
            yield "symbol", function, bound[w], t.word[k + 2], t.line.of(t.at[k + 2])
        if after == "(" and k not in named and w not in _GO_WORDS and not any(a < k < b and t.get(k - 1) in ("{", ";") or a < k < b and not t.same_line(k - 1, k) for a, b in shapes):
            yield "call", function, "", w, t.line.of(t.at[k])


def _go_end(t: Tokens, opens: int) -> int:
    """The end of a Go function: its body's brace, past result types, some of which have braces of their own."""
    k = t.partner.get(opens, opens) + 1
    while k < len(t.word):
        if t.word[k] == "{" and t.get(k - 1) not in ("struct", "interface"):
            return t.partner.get(k, len(t.word))
        if not t.same_line(k - 1, k) and t.word[k - 1] not in (",", "(", "{"):
            return k - 1
        k = t.partner.get(k, k) + 1 if t.word[k] in _PAIR else k + 1
    return k


# PHP

_PHP_WORDS = {"if", "elseif", "while", "for", "foreach", "switch", "match", "catch", "function", "fn", "array", "list", "unset", "exit", "echo", "print", "declare", "return", "and", "or", "xor", "use", "include", "include_once", "require", "require_once", "else", "do", "throw", "yield", "static"}
_PHP_USE = re.compile(r"(?i)(?<![\w$\\>])use\s+([^;(){}]*(?:\{[^{};]*\})?[^;(){}]*);")


def _php_bindings(top: str) -> dict[str, str]:
    out = {}
    for m in _PHP_USE.finditer(top):
        group = re.match(r"(?s)\s*([^{]*?)[\s\\]*\{([^}]*)\}", m[1])
        prefix, items = (group[1] + "\\", group[2]) if group else ("", m[1])
        for item in items.split(","):
            found = re.match(r"(?i)\s*(?:(?:function|const)\s+)?([^\s]+)(?:\s+as\s+(\w+))?", re.sub(r"(?i)\A\s*(?:function|const)\s+", "", item))
            if found:
                full = re.sub(r"(?i)\A(?:function|const)\s+", "", prefix) + found[1]
                out[found[2] or full.rsplit("\\", 1)[-1]] = full
    return out


def php_uses(bare: str, top: str) -> Iterator[tuple[str, str, str, str, int]]:
    bound, t = _php_bindings(top), Tokens.of(bare)
    found, named = [], set()
    for k, w in enumerate(t.word):
        if w.lower() == "function" and t.get(k - 1) not in ("->", "::", "?->"):
            j = k + 1 + (t.get(k + 1) == "&")
            if t.is_name(j) and t.get(j + 1) == "(":
                named.add(j)
                found.append((k, _body_end(t, j + 1), t.word[j]))
    scopes = _Scopes(found)
    for k, w in enumerate(t.word):
        function = scopes.at(k)
        if not t.is_name(k) or w.startswith("$"):
            continue
        before, after = t.get(k - 1), t.get(k + 1)
        if after == "::" and before not in ("\\", "->", "::", "?->") and w in bound and t.is_name(k + 2) and not t.get(k + 2).startswith("$"):
            yield "symbol", function, bound[w], t.word[k + 2], t.line.of(t.at[k + 2])
        if after == "(" and k not in named and (before in ("->", "?->", "::") or w.lower() not in _PHP_WORDS):
            j = k - 1
            while t.get(j) == "\\" or (t.is_name(j) and t.get(j + 1) == "\\"):
                j -= 1
            if before in ("->", "?->", "::") or t.get(j) != "new":
                yield "call", function, "", w, t.line.of(t.at[k])


# Rust

MOST_NESTED = 64


def rust_paths(tree: str) -> list[tuple[str, str | None]]:
    """(full path, alias or None) of every leaf of a ``use`` tree; groups beyond MOST_NESTED stay as they are."""
    out: list[tuple[str, str | None]] = []
    prefixes, start = [""], 0

    def joined(prefix: str, part: str) -> str:
        return f"{prefix}::{part}" if prefix and part else prefix or part

    def leaf(text: str) -> None:
        text = text.strip()
        if text:
            path, _, alias = (x.strip() for x in re.sub(r"\s+as\s+", "\x00", text).partition("\x00"))
            out.append((joined(prefixes[-1], path), alias or None))

    for m in re.finditer(r"[{},]", tree):
        text = tree[start : m.start()]
        if m[0] == "{" and len(prefixes) <= MOST_NESTED:
            prefixes.append(joined(prefixes[-1], text.strip().removesuffix("::").rstrip()))
        elif m[0] != "{":
            leaf(text)
            if m[0] == "}" and len(prefixes) > 1:
                prefixes.pop()
        else:
            continue
        start = m.end()
    leaf(tree[start:])
    return out


def rust_dep_key(path: str) -> str:
    first = re.match(r"\s*(?:::)?\s*([^:{},\s]*)", path)[1]
    return "" if first in ("", "crate", "self", "super", "std", "core", "alloc") else first


_RUST_USE = re.compile(r"(?<![\w$])(?:use\s+([\w:{}*,#\s]+?)|extern\s+crate\s+[\w\s]+?)\s*;")
_RUST_TYPE = {":", "->", "impl", "dyn", "as", "for", "<"}


def rust_uses(bare: str) -> Iterator[tuple[str, str, str, str, int]]:
    """Symbols only, all under ``<module>``: functions of Rust are not told apart."""
    bound: dict[str, tuple[str, str]] = {}
    roots, stretches = set(), []
    for m in _RUST_USE.finditer(bare):
        stretches.append((m.start(), m.end()))
        for path, alias in rust_paths(m[1] or ""):
            module, last = rust_dep_key(path), path.rsplit("::", 1)[-1].strip()
            if module:
                roots.add(module)
                if last not in ("*", ""):
                    bound[alias or last] = (module, last)
    t, at, k = Tokens.of(bare), 0, -1
    while (k := k + 1) < len(t.word):
        while at < len(stretches) and stretches[at][1] <= t.at[k]:
            at += 1
        w, before = t.word[k], t.get(k - 1)
        if not t.is_name(k) or (at < len(stretches) and stretches[at][0] <= t.at[k]) or before in (".", "::"):
            continue
        line, end = t.line.of(t.at[k]), k
        while t.get(end + 1) == "::" and t.is_name(end + 2):
            end += 2
        if end > k:
            if before not in _RUST_TYPE or t.get(end + 1) in ("(", "!"):
                if w in bound:
                    yield "symbol", MODULE, bound[w][0], t.word[k + 2], line
                elif rust_dep_key(w) in roots:
                    yield "symbol", MODULE, w, t.word[k + 2], line
            k = end
        elif w in bound and before != "fn" and (t.get(k + 1) == "(" or (t.get(k + 1) == "::" and t.get(k + 2) == "<")):
            yield "symbol", MODULE, *bound[w], line


def uses(language: str, code: str, bare: str, top: str | None) -> list[tuple[str, str, str, str, int]]:
    """All distinct rows of one masked source, sorted; other languages have none."""
    found = {"js": lambda: js_uses(code, bare), "go": lambda: go_uses(code, bare), "php": lambda: php_uses(bare, top or ""), "rust": lambda: rust_uses(bare)}.get(language, lambda: ())
    return sorted(set(found()))
