"""A table-driven lexer of source texts: which stretches are comments and which are the insides of strings.

A language is a table of token openings. One pattern finds the next of them, so code between tokens is passed over by the
regex engine; a token that ends by a rule (nested comments, raw strings with their own delimiters, templates with code in
holes, heredocs) is then followed to its end. Code in a hole of a string is code again, by a stack of open strings.

``masked`` returns two texts of the same length and lines: one without comments, in which the quotes inside strings are
blanked too, so that a pattern with quotes cannot match within a string, and one without the insides of strings.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cache

COMMENT, STRING = "comment", "string"


@dataclass(frozen=True)
class Text:
    """A kind of string: how it opens; how it ends (a template of the opening's groups); what escapes; what opens a hole."""

    opens: str
    ends: str = ""
    escape: str = r"\\."
    hole: str = ""
    hole_end: str = "}"
    lines: bool = True  # goes on over lines
    after: str = ""  # what has to stand before: checked on the last code


@dataclass(frozen=True)
class Language:
    line: tuple[str, ...] = ("//",)
    blocks: tuple[tuple[str, str], ...] = ((r"/\*", r"\*/"),)
    nested: bool = False
    texts: tuple[Text, ...] = ()
    skip: str = ""  # stretches that look like openings and are none
    heredoc: str = ""  # opening of a heredoc, with the groups ``name`` and, if raw, ``raw``
    outside: tuple[str, str] = field(default=("", ""))  # what opens and closes code in a text that is else no code


_Q = Text('"', '"', lines=False)
_A = Text("'", "'", lines=False)
_CHAR = r"'(?:\\[^\n]|[^\\'\n])'"
_LONG = Text('"""', '"""')
_INTERPOLATED = Text('"', '"', hole=r"#\{")
_C_STRINGS = (Text(r'(?:u8|[uUL])?R"(?P<r>[^()\\ \n]{0,16})\(', ')(r)"', escape=""), _Q)
_JS = (
    Text("`", "`", hole=r"\$\{"), _Q, _A, Text(r"/(?![/*])(?=(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/)", "/", escape=r"\\.|\[(?:\\.|[^\]\\\n])*\]", lines=False, after="regex"),
)
_RUBY = Language(
    line=(r"(?<![\w$?#])\#",), blocks=((r"(?m:^=begin\b)", r"(?m:^=end\b[^\n]*)"),), skip=r"\?[\"'`#](?!\w)|\$[\"'`]",
    texts=(Text(r"%[qwi]\(", ")"), Text(r"%[QWI]?\((?=[^)\n]*\))", ")", hole=r"#\{", after="regex"), _INTERPOLATED, Text("'", "'"), Text("`", "`", hole=r"#\{")),
    heredoc=r"<<[~-](?:'(?P<raw>\w+)'|\"?(?P<name>[A-Za-z_]\w*)\"?)|<<(?P<plain>[A-Z_][A-Z_0-9]*)\b",
)
LANGUAGES: dict[str, Language] = {
    "js": Language(texts=_JS), "java": Language(texts=(_LONG, _Q), skip=_CHAR), "c": Language(texts=(_Q,), skip=r"(?<=\w)'|" + _CHAR), "cpp": Language(texts=_C_STRINGS, skip=r"(?<=\w)'(?=\w)|" + _CHAR),
    "py": Language(line=(r"\#",), blocks=(), texts=(_LONG, Text("'''", "'''"), _Q, _A)),
    "ruby": _RUBY, "cocoapods": _RUBY, "go": Language(texts=(Text("`", "`", escape=""), _Q), skip=_CHAR),
    "php": Language(line=("//", r"\#(?!\[)"), texts=(Text('"', '"'), Text("'", "'"), Text("`", "`")), heredoc=r"<<<\s*(?:'(?P<raw>\w+)'|\"?(?P<name>[A-Za-z_]\w*)\"?)(?=\s*\n)", outside=(r"<\?(?:php\b|=)", r"\?>")),
    "rust": Language(nested=True, texts=(Text(r'\bb?r(?P<h>\#*)"', '"(h)', escape=""), Text('"', '"')), skip=r"'(?:\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])'"),
    "c#": Language(texts=(Text(r'\$*(?P<q>"{3,})', "(q)", escape=""), Text(r'\$@"|@\$"', '"', escape='""', hole=r"\{(?!\{)"), Text('@"', '"', escape='""'), Text(r'\$"', '"', escape=r"\\.|\{\{", hole=r"\{", lines=False), _Q), skip=_CHAR),
    "bash": Language(line=(r"(?<![^\s;&|(){}])\#",), blocks=(), texts=(Text(r"\$'", "'"), Text("'", "'", escape=""), Text('"', '"', hole=r"\$\(", hole_end=")")), skip=r"\\.", heredoc=r"<<-?\s*(?:'(?P<raw>\w+)'|\"?(?P<name>[A-Za-z_]\w*)\"?)"),
    "elixir": Language(line=(r"\#",), blocks=(), texts=(Text('"""', '"""', hole=r"#\{"), Text(r"~[sc]\(", ")", hole=r"#\{"), Text(r"~[SC]\(", ")"), _INTERPOLATED, Text("'", "'", hole=r"#\{")), skip=r"\?[\"'#]"),
    "kotlin": Language(nested=True, texts=(Text('"""', '"""', escape="", hole=r"\$\{"), Text('"', '"', hole=r"\$\{", lines=False)), skip=_CHAR),
    "swift": Language(nested=True, texts=(Text(r'(?P<h>\#+)"', '"(h)', escape=""), Text('"""', '"""', escape=r"\\[^(]", hole=r"\\\(", hole_end=")"), Text('"', '"', escape=r"\\[^(]", hole=r"\\\(", hole_end=")", lines=False))),
    "lua": Language(line=(r"--(?!\[=*\[)",), blocks=((r"--\[(?P<c>=*)\[", r"\](c)\]"),), texts=(Text(r"\[(?P<b>=*)\[", "](b)]", escape=""), _Q, _A)),
    "dart": Language(nested=True, texts=(Text(r"\br'''", "'''", escape=""), Text(r'\br"""', '"""', escape=""), Text(r"\br'", "'", escape="", lines=False), Text(r'\br"', '"', escape="", lines=False), Text("'''", "'''", hole=r"\$\{"), Text('"""', '"""', hole=r"\$\{"), Text("'", "'", hole=r"\$\{", lines=False), Text('"', '"', hole=r"\$\{", lines=False))),
    "haskell": Language(line=(r"--+(?![!#$%&*+./<=>?@\\^|~:-])",), blocks=((r"\{-", r"-\}"),), nested=True, texts=(Text('"', '"'),), skip=r"(?<=\w)'|" + _CHAR),
    "gleam": Language(blocks=(), texts=(Text('"', '"'),)),
}
# Words after which a slash begins a regex literal, not a division.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "and", "or", "not", "if", "unless", "while", "puts"}
_WORD_END = re.compile(r"[\w$]+\Z")


def _filled(ends: str, found: re.Match) -> str:
    """The text that closes what ``found`` opened."""
    return re.sub(r"\((\w)\)", lambda m: found[m[1]], ends)


@cache
def _stop(text: Text, end: str) -> re.Pattern:
    parts = [*([f"(?P<escape>{text.escape})"] if text.escape else []), f"(?P<end>{re.escape(end)})", *([f"(?P<hole>{text.hole})"] if text.hole else []), *([] if text.lines else ["(?P<line>\n)"])]
    return re.compile("|".join(parts), re.DOTALL)


@cache
def _block(opens: str, ends: str) -> re.Pattern:
    return re.compile(f"(?P<end>{ends})|(?P<open>{opens})")


@cache
def _openings(name: str, holes: bool) -> tuple[Language, re.Pattern]:
    lang = LANGUAGES[name]
    parts = [f"(?P<skip>{lang.skip})"] if lang.skip else []
    parts += [f"(?P<block{i}>{o})" for i, (o, _) in enumerate(lang.blocks)] + [f"(?P<line{i}>{o})" for i, o in enumerate(lang.line)]
    parts += [f"(?P<heredoc>{lang.heredoc})"] if lang.heredoc else []
    parts += [f"(?P<text{i}>{t.opens})" for i, t in enumerate(lang.texts)]
    parts += [f"(?P<leave>{lang.outside[1]})"] if lang.outside[1] else []
    parts += [r"(?P<brace>[{}()])"] if holes else []
    return lang, re.compile("|".join(parts))


class _Lexer:
    def __init__(self, text: str, name: str):
        self.text, self.name, self.lang = text, name, LANGUAGES[name]
        self.spans: list[tuple[int, int, str]] = []
        self.stack: list[list] = []  # open holes: [text rule, closing text, brackets open]
        self.waiting: list[re.Pattern] = []  # heredocs that begin on the next line

    def add(self, start: int, end: int, kind: str) -> None:
        if end > start:
            self.spans.append((start, end, kind))

    def last_code(self, at: int) -> str:
        """The last characters of code before ``at``, on which depends whether a slash divides."""
        k, i = at, len(self.spans) - 1
        while True:
            head = self.text[max(0, k - 40) : k].rstrip()
            if head or k <= 0:
                return head
            k = max(0, k - 40)
            while i >= 0 and self.spans[i][0] >= k:
                i -= 1

    def value_may_begin(self, at: int) -> bool:
        if self.spans and self.spans[-1][2] == COMMENT and not self.text[self.spans[-1][1] : at].strip():
            at = self.spans[-1][0]
        head = self.last_code(at)
        if not head:
            return True
        word = _WORD_END.search(head)
        return word[0] in _BEFORE_VALUE if word else head[-1] not in ")]}\"'`"

    def inside(self, rule: Text, end: str, at: int) -> int:
        """Follow a string from ``at`` to its end, or into a hole; the position after either."""
        stop, start = _stop(rule, end), at
        while found := stop.search(self.text, at):
            kind, at = found.lastgroup, found.end()
            if kind == "escape":
                continue
            self.add(start, found.start(), STRING)
            if kind == "hole":
                self.stack.append([rule, end, 0])
            return found.start() if kind == "line" else at
        self.add(start, len(self.text), STRING)
        return len(self.text)

    def block(self, found: re.Match, which: int) -> int:
        opens, ends = self.lang.blocks[which]
        if "(c)" in ends:
            closed = self.text.find("]" + found["c"] + "]", found.end())
            at = len(self.text) if closed < 0 else closed + len(found["c"]) + 2
        else:
            depth, at = 1, found.end()
            pattern = _block(opens, ends)
            while depth and (m := pattern.search(self.text, at)):
                at = m.end()
                depth += -1 if m.lastgroup == "end" else self.lang.nested
            at = at if not depth else len(self.text)
        self.add(found.start(), at, COMMENT)
        return at

    def heredocs(self, at: int) -> int:
        """The bodies of the heredocs that wait, from the line after ``at``."""
        for name in self.waiting:
            line = self.text.find("\n", at)
            if line < 0:
                break
            end = name.search(self.text, line)
            stop = end.start() + 1 if end else len(self.text)
            self.add(line + 1, stop, STRING)
            at = end.end() if end else len(self.text)
        self.waiting = []
        return at

    def code(self, at: int) -> int:
        """Lex code from ``at``; the position where it ends."""
        while True:
            _, pattern = _openings(self.name, bool(self.stack))
            found = pattern.search(self.text, at)
            if self.waiting:
                line = self.text.find("\n", at)
                if line >= 0 and (not found or found.start() > line):
                    at = self.heredocs(line)
                    continue
            if not found:
                return len(self.text)
            kind = next(k for k, v in found.groupdict().items() if v is not None and (k[:4] in ("skip", "line", "text") or k[:5] in ("block", "brace", "leave") or k == "heredoc"))
            at = found.end()
            if kind == "leave":
                return at
            if kind.startswith("block"):
                at = self.block(found, int(kind[5:]))
            elif kind.startswith("line"):
                end = re.compile(r"\n|(?=\?>)" if self.lang.outside[1] else r"\n").search(self.text, at)
                at = end.start() if end else len(self.text)
                self.add(found.start(), at, COMMENT)
            elif kind == "heredoc":
                name = found["raw"] or found["name"] or found.groupdict().get("plain")
                self.waiting.append(re.compile(rf"\n[ \t]*{re.escape(name)}\b"))
            elif kind.startswith("text"):
                rule = self.lang.texts[int(kind[4:])]
                if rule.after == "regex" and not self.value_may_begin(found.start()):
                    at = found.start() + 1
                    continue
                at = self.inside(rule, _filled(rule.ends, found), at)
            elif kind == "brace":
                hole, mark = self.stack[-1], found[0]
                opening, closing = ("(", ")") if hole[0].hole_end == ")" else ("{", "}")
                if mark == opening:
                    hole[2] += 1
                elif mark == closing and hole[2]:
                    hole[2] -= 1
                elif mark == closing:
                    self.stack.pop()
                    at = self.inside(hole[0], hole[1], at)

    def run(self) -> list[tuple[int, int, str]]:
        opens = self.lang.outside[0]
        if not opens:
            self.code(0)
            return self.spans
        at, pattern = 0, re.compile(opens)
        while found := pattern.search(self.text, at):
            self.add(at, found.start(), COMMENT)  # a page around the code
            at = self.code(found.end())
        self.add(at, len(self.text), COMMENT)
        return self.spans


def spans(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, comment or string) in order; a string's span is its inside, without delimiters and holes."""
    return _Lexer(text, language).run()


_INK = re.compile(r"[^\n]+")
_QUOTES = str.maketrans("\"'`", "   ")


def _blank(text: str) -> str:
    return _INK.sub(lambda m: " " * len(m[0]), text)


def masked(text: str, language: str) -> tuple[str, str]:
    """(text without comments and without quotes inside strings, text without comments and insides of strings)."""
    code, bare, at = [], [], 0
    for start, end, kind in spans(text, language):
        plain, piece = text[at:start], text[start:end]
        blank = _blank(piece)
        code += [plain, blank if kind == COMMENT else piece.translate(_QUOTES)]
        bare += [plain, blank]
        at = end
    return "".join([*code, text[at:]]), "".join([*bare, text[at:]])


def outer(bare: str) -> str:
    """A masked text with what stands in braces blanked, but for the bodies of namespaces and the groups of imports."""
    out, at, depth, kept = [], 0, 0, []
    for m in re.finditer(r"[{}]", bare):
        out.append(bare[at : m.start()] if not depth else _blank(bare[at : m.start()]))
        at = m.start()
        if m[0] == "{":
            keep = not depth and bool(re.search(r"\bnamespace\b[^;{}]*\Z|\\\s*\Z", bare[max(0, at - 300) : at]))
            kept.append(keep)
            depth += not keep
        elif kept:
            depth -= not kept.pop()
    out.append(bare[at:] if not depth else _blank(bare[at:]))
    return "".join(out)


class Lines:
    """Line numbers of positions."""

    def __init__(self, text: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def of(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1
