"""Personal data by a skip-chain conditional random field over mentions: numbers and addresses, each as a whole.

Base spans come from fixed patterns (e-mail, IP, card, phone) and always stay. Beside them, every run of digit groups,
every token with an at sign and every address spelled with ``(at)`` is a candidate mention. The field labels mentions:
unary potentials are a softmax regression over a mention's looks, chain edges join mentions that stand next to each
other, and skip edges join distant mentions that repeat: the same text (type 1), the same digits or address in another
spelling (type 2), the same last nine digits (type 3). Parts of a number are never joined to anything. Base spans are
observed; loopy sum-product messages carry their labels along the edges until they settle, and a mention that ends up
labelled with SURE becomes an added span.

A mention is joined to the observed ones of its key next before and after it; where none is observed, all mentions of a
key are joined through one hub. So edges are linear in mentions, whatever repeats, and no label passes through many.

All potentials, ties included, are fitted together by pseudo-likelihood on a sample of about ``max_docs`` documents,
chosen by a hash of the id. Base spans are the labels. As patterns decide those by looks alone, each base span is also
shown rewritten in a spelling that the patterns miss, joined to its original, and against it decoys of the same looks
that are joined to nothing and are no personal data: what looks leave open, the field has to take from its ties.

Nulls and empty texts have no spans; texts of any length are read whole, in linear time. Empty tables give no rows.
Repeated rows are treated alike; ties of labels go to none; extra columns are ignored. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"\+?[0-9]+(?:[ ().-]{1,3}[0-9]+)*")
_SPELLED = re.compile(r"[\[({] ?(?:at|AT) ?[\])}]")
_SPELLED_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?)[A-Za-z0-9-]+)+")
_DOT = re.compile(r" ?[\[({] ?dot ?[\])}] ?")
_GAP = re.compile(r"\s")
_OUTER = ".,;:!?()[]{}<>\"'"
_MARK = np.zeros(256, bool)
_MARK[48:58] = _MARK[64] = True
SETTLED = 1e-4
STEADY_ROUNDS, HALVE_ROUNDS = 200, 50
CLAMP = 12.0
SURE = 0.8
KEY_DIGITS, LAST_DIGITS = 7, 9
TYPES = 4


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _number(part: str) -> int:
    part = part.lstrip("0")
    return 999 if len(part) > 3 else int(part or 0)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted; each kind leftmost and non-overlapping by itself."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(_number(p) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digit groups that no letter touches; groups of nine digits or more, parted by spaces, stand by themselves."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "_@") or b < len(text) and (text[b].isalnum() or text[b] in "_@"):
            continue
        if b - a <= LAST_DIGITS or " " not in m[0]:
            yield a, b
            continue
        first = at = a
        for part in m[0].split(" "):
            if len(part) >= LAST_DIGITS:
                if first < at:
                    yield first, at - 1
                yield at, at + len(part)
                first = at + len(part) + 1
            at += len(part) + 1
        if first < b:
            yield first, b


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with an at sign, and addresses with a spelled one."""
    at = text.find("@")
    begin = 0
    while at >= 0:
        a = at
        while a > begin and not text[a - 1].isspace():
            a -= 1
        end = _GAP.search(text, at)
        begin = end.start() if end else len(text)
        yield a, begin
        at = text.find("@", begin)
    done = 0
    for m in _SPELLED.finditer(text):
        a = m.start()
        if a > done and text[a - 1] == " ":
            a -= 1
        name = a
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        found = _SPELLED_DOMAIN.match(text, m.end()) if a < name else None
        if found:
            done = found.end()
            yield a, done


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label): base spans with their labels, and candidates (label 0) beside them, in order."""
    out = [(s, e, k + 1) for s, k, e in base]
    starts, top = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    taken = 0
    for a, b in sorted({*_numbers(text), *_addresses(text)}, key=lambda x: (x[0], -x[1])):
        while a < b and (text[a] in _OUTER or text[a] == " "):
            a += 1
        while b > a and (text[b - 1] in _OUTER or text[b - 1] == " "):
            b -= 1
        if taken < a < b and text[a - 1] == "(" and ")" in text[a:b]:
            a -= 1
        i = bisect_left(starts, b)
        if a < b and a >= taken and not (i and top[i - 1] > a):
            out.append((a, b, 0))
            taken = b
    return sorted(out)


def keys(mention: str) -> tuple[str, str, str]:
    """The mention's text, its spelling-free form, and its last nine digits; '' where it has none."""
    text = mention.lower()
    if "@" in text:
        return text, text, ""
    if _SPELLED.search(text):
        return text, _DOT.sub(".", _SPELLED.sub("@", text)).replace(" ", ""), ""
    digits = _digits(text)
    if len(digits) < KEY_DIGITS or len(digits) <= 12 and text.count(".") == 3:  # dotted quads are known by their text
        return text, "", ""
    return text, digits, digits[-LAST_DIGITS:] if LAST_DIGITS <= len(digits) <= 15 else ""


def skips(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], int]:
    """Skip edges (i, j, type) and the number of hubs (~0, ~1, ... in the edges)."""
    known = [keys(text[a:b]) for a, b, _ in found]
    observed: list[dict[str, list[int]]] = [{}, {}, {}]
    for i, (_, _, label) in enumerate(found):
        if label:
            for kind in range(3):
                if known[i][kind]:
                    observed[kind].setdefault(known[i][kind], []).append(i)
    edges, loose = [], {}
    for i, (_, _, label) in enumerate(found):
        if label:
            continue
        partners: dict[int, int] = {}
        for kind in range(3):
            sources = observed[kind].get(known[i][kind], []) if known[i][kind] else []
            at = bisect_left(sources, i)
            for j in sources[max(at - 1, 0) : at + 1]:
                partners.setdefault(j, kind + 1)
        edges += [(j, i, kind) for j, kind in partners.items()]
        if not partners and known[i][1]:
            loose.setdefault(known[i][1], []).append(i)
    hubs = 0
    for group in loose.values():
        kind = 1 if len({known[i][0] for i in group}) == 1 else 2
        if len(group) == 2:
            edges.append((*group, kind))
        elif len(group) > 2:
            edges += [(~hubs, i, kind) for i in group]
            hubs += 1
    return edges, hubs


def chain(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return [(i - 1, i, 0) for i in range(1, len(found)) if 0 <= found[i][0] - found[i - 1][1] <= 3]


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def shape(mention: str) -> tuple[int, ...]:
    """Categories of a mention's looks."""
    digits = _digits(mention)
    at = 1 if "@" in mention else 2 if _SPELLED.search(mention) else 0
    parts = [c for c in (" ", "-", ".") if c in mention]
    return (
        0 if at else _bucket(len(digits), (1, 4, 7, 9, 10, 12, 13, 16, 20)),
        (1 + " -.".index(parts[0]) if len(parts) == 1 else 4) if parts else 0,
        at,
        int(mention.startswith("+")),
        0 if at else _bucket(sum(c.isalpha() for c in mention), (1, 4, 12)),
        int(at == 1 and "." in mention.rpartition("@")[2].strip(".")),
        1 + luhn(digits) if not at and 12 <= len(digits) <= 19 else 0,
        int(mention.count(".") == 3 and not at),
    )


WIDTHS = (10, 5, 3, 2, 4, 2, 3, 2)
_FIRST = np.concatenate([[0], np.cumsum(WIDTHS)])


def one_hot(shapes: np.ndarray) -> np.ndarray:
    x = np.zeros((len(shapes), _FIRST[-1] + 1))
    for k, first in enumerate(_FIRST[:-1]):
        x[np.arange(len(shapes)), first + shapes[:, k]] = 1
    x[:, -1] = 1
    return x


def _other_digits(text: str) -> str:
    """The same looks with other digits."""
    seed = crc32(text.encode())
    return "".join(str((int(c) + 1 + (seed >> (k % 24)) % 9) % 10) if "0" <= c <= "9" else c for k, c in enumerate(text))


def rewritten(mention: str, label: int) -> list[tuple[str, int]]:
    """(text, type of its tie to the mention): spellings of a base span that the patterns miss."""
    digits = _digits(mention)
    if label == 1:
        name, _, domain = mention.partition("@")
        out = [(f"{name} (at) {domain}", 2), (f"{name}[at]{domain}", 2), (f"{name} (at) {domain.replace('.', ' (dot) ')}", 2)]
    elif label == 3:
        out = [(".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), 2)]
    elif label == 4:
        last = digits[-10:]
        out = [(digits, 2), (f"{last[:3]}-{last[3:6]}-{last[6:]}", 3), (f"({last[:3]}) {last[3:6]}-{last[6:]}"[1:], 3), (last, 3)]
    else:
        out = []
    return [(t, kind) for t, kind in out if not base_spans(t)]


def decoys(mention: str, label: int) -> list[str]:
    """Texts like the mention that are no personal data by the patterns: too few or too many digits, half an address."""
    if label == 1:
        name, _, domain = mention.partition("@")
        out = [f"{name}@", f"@{name}", f"{name}@{domain.partition('.')[0]}"]
    else:
        digits = _digits(mention)
        out = [digits[:8], _other_digits(digits + digits), _other_digits(digits[:6]), digits[:3]]
    return [t for t in out if t and not base_spans(t)]


def examples(text: str) -> Iterator[tuple[tuple[int, ...], int, tuple[tuple[int, int], ...]]]:
    """(shape, label, neighbours as (type, label)) of every mention, of rewritten base spans and of decoys."""
    base = base_spans(text)
    found = mentions(text, base)
    labels = [label for _, _, label in found]
    near: list[list[tuple[int, int]]] = [[] for _ in found]
    for i, j, kind in [*chain(found), *(e for e in skips(text, found)[0] if e[0] >= 0)]:
        near[i].append((kind, labels[j]))
        near[j].append((kind, labels[i]))
    last: dict[tuple, int] = {}
    for i, (a, b, label) in enumerate(found):
        if label:  # repeats among base spans are joined one to the next
            text_key, form, _ = keys(text[a:b])
            for kind, key in ((1, text_key), (2, form)):
                j = last.get((kind, key)) if key else None
                if j is not None and labels[j] and (kind == 1 or text[found[j][0] : found[j][1]].lower() != text_key):
                    near[i].append((kind, labels[j]))
                    break
            last[1, text_key] = last[2, form] = i
    for (a, b, label), ties in zip(found, near, strict=True):
        mention = text[a:b]
        if not label and any(kind and other for kind, other in ties):
            continue  # a spelling of a base span: what it is, is for the field to say
        yield shape(mention), label, tuple(sorted(ties))
        if label:
            for other, kind in rewritten(mention, label):
                yield shape(other), label, ((kind, label),)
                yield shape(_other_digits(other)), 0, ()
            for other in decoys(mention, label):
                yield shape(other), 0, ()


@dataclass
class Model:
    weights: np.ndarray  # (features, labels)
    ties: np.ndarray  # log potential of equal labels, by edge type


def train(shapes: np.ndarray, labels: np.ndarray, near: np.ndarray, n: np.ndarray, steps: int = 800, decay: float = 2e-4) -> Model:
    """Maximise the pseudo-likelihood of labels given shapes and ``near`` (rows, types, labels): counts of neighbours."""
    weights, ties = np.zeros((_FIRST[-1] + 1, len(LABELS))), np.zeros(TYPES)
    if not len(labels) or not labels.any():
        weights[-1, 0] = CLAMP  # without a base span nothing is ever added
        return Model(weights, ties)
    x, rows = one_hot(shapes), np.arange(len(labels))
    share = np.sqrt(n.astype(float))
    share /= share.sum()
    fast_w, fast_t = np.zeros_like(weights), np.zeros_like(ties)
    for _ in range(steps):
        z = x @ weights + np.einsum("t,rtl->rl", ties, near)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[rows, labels] -= 1
        p *= share[:, None]
        fast_w = 0.9 * fast_w + x.T @ p + decay * weights
        fast_t = 0.9 * fast_t + np.einsum("rl,rtl->t", p, near) + decay * ties
        weights -= 0.5 * fast_w
        ties -= 0.5 * fast_t
    return Model(weights, ties)


def _sent(out: np.ndarray, tie: np.ndarray) -> np.ndarray:
    p = np.exp(out - out.max(axis=1, keepdims=True))
    m = np.log(p.sum(axis=1, keepdims=True) + (tie - 1) * p)
    return m - m.max(axis=1, keepdims=True)


def infer(model: Model, shapes: np.ndarray, clamped: np.ndarray, edges: np.ndarray, hubs: int = 0) -> np.ndarray:
    """Label beliefs (nodes, labels) by loopy sum-product message passing; ``hubs`` nodes after the mentions have no shape.

    Messages go on until none changes by more than SETTLED, and only where something changed. Those that swing for long
    take ever smaller steps, so that every field settles.
    """
    unary = one_hot(shapes) @ model.weights
    belief = np.concatenate([unary - unary.max(axis=1, keepdims=True), np.zeros((hubs, len(LABELS)))])
    fixed = np.zeros(len(belief), bool)
    fixed[: len(clamped)] = clamped > 0
    hit = np.flatnonzero(fixed)
    belief[hit] = -CLAMP
    belief[hit, clamped[hit]] = 0
    if len(edges):
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        tie = np.exp(np.tile(model.ties[edges[:, 2]], 2))[:, None]
        once = np.flatnonzero(fixed[src] & ~fixed[dst])  # what is clamped never changes what it sends
        np.add.at(belief, dst[once], _sent(belief[src[once]], tie[once]))
        free = np.flatnonzero(~fixed[src] & ~fixed[dst])  # both directions of an edge, or none
        src, dst, tie, n = src[free], dst[free], tie[free], len(free) // 2
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        sent = np.zeros((2 * n, len(LABELS)))
        live, rounds = np.arange(2 * n), 0
        while len(live):
            step = 0.5 ** (1 + max(0, rounds - STEADY_ROUNDS) // HALVE_ROUNDS)
            change = step * (_sent(belief[src[live]] - sent[back[live]], tie[live]) - sent[live])
            sent[live] += change
            np.add.at(belief, dst[live], change)
            moved = live[np.abs(change).max(axis=1) > SETTLED]
            node, edge = np.zeros(len(belief), bool), np.zeros(2 * n, bool)
            node[dst[moved]] = edge[moved] = True
            live, rounds = np.flatnonzero(edge | node[src]), rounds + 1
            if not len(moved):
                break
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _marked(column: pa.Array) -> np.ndarray:
    """Which rows hold a digit or an at sign."""
    raw, offsets = tk.string_buffers(column)
    return np.flatnonzero(tk.sum_by_row(_MARK[raw], offsets))


def fit(docs: DataFrame, max_docs: int = 20000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """All potentials from base spans on a sample of documents; only counts of distinct examples reach the driver."""
    total = max(docs.count(), 1)
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.where(part < min(1.0, max_docs / total)).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            rows: dict[tuple, int] = {}
            for i in _marked(part.column(0)):
                for looks, label, near in examples(part.column(0)[int(i)].as_py()):
                    key = (",".join(map(str, looks)), label, ",".join(f"{k * len(LABELS) + v}" for k, v in near))
                    rows[key] = rows.get(key, 0) + 1
            cols = list(zip(*((*k, v) for k, v in rows.items()), strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["shape", "label", "near", "n"])

    got = sample.mapInArrow(run, "shape string, label int, near string, n long").groupBy("shape", "label", "near").agg(F.sum("n").alias("n")).toPandas()
    got = got.sort_values(["shape", "label", "near"])
    near = np.zeros((len(got), TYPES * len(LABELS)))
    for k, ties in enumerate(got["near"]):
        for tie in ties.split(",") if ties else ():
            near[k, int(tie)] += 1
    shapes = np.array([list(map(int, s.split(","))) for s in got["shape"]]).reshape(-1, len(WIDTHS))
    return train(shapes, got["label"].to_numpy(int), near.reshape(-1, TYPES, len(LABELS)), got["n"].to_numpy())


def find(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; all graphs of the list go through message passing together."""
    base = [base_spans(t) for t in texts]
    found = [mentions(t, b) for t, b in zip(texts, base, strict=True)]
    first = list(accumulate(map(len, found), initial=0))
    if not first[-1]:
        return [(b, []) for b in base]
    edges, hubs = [], 0
    for text, nodes, at in zip(texts, found, first, strict=False):
        joined, more = skips(text, nodes)
        edges += [(i + at if i >= 0 else first[-1] + hubs + ~i, j + at, kind) for i, j, kind in chain(nodes) + joined]
        hubs += more
    shapes = np.array([shape(t[a:b]) for t, nodes in zip(texts, found, strict=True) for a, b, _ in nodes])
    clamped = np.array([label for nodes in found for _, _, label in nodes])
    belief = infer(model, shapes, clamped, np.array(edges, np.int64).reshape(-1, 3), hubs)[: first[-1]]
    label = np.where((belief.max(axis=1) >= SURE) & (clamped == 0), belief.argmax(axis=1), 0)
    return [(b, [(x, int(k) - 1, y) for (x, y, _), k in zip(nodes, label[s:e], strict=True) if k]) for b, nodes, s, e in zip(base, found, first[:-1], first[1:], strict=True)]


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row, spans sorted by start, then kind."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, text_col):
            rows: list[list] = [[] for _ in range(part.num_rows)]
            at = _marked(part.column(1))
            for i, (base, more) in zip(at, find([part.column(1)[int(i)].as_py() for i in at], sent.value), strict=True):
                every = sorted([(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in more])
                rows[i] = [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in every]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _SPAN)], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, spans {SPANS}")


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hash of base spans, and all spans as a string."""
    base = F.filter("spans", lambda s: s["base"])
    word = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return spans.select(
        id_col, *counts, F.sha2(F.concat_ws(",", F.transform(base, word)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", word)).alias("spans")
    )


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by the kind of its first in brackets."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, text_col):
            k = part.schema.get_field_index(text_col)
            texts = part.column(k).to_pylist()
            at = _marked(part.column(k))
            for i, (base, more) in zip(at, find([texts[i] for i in at], sent.value), strict=True):
                out, done = [], 0
                for s, kind, e in sorted(base + more):
                    if s >= done:
                        out += (texts[i][done:s], f"[{KINDS[kind].upper()}]")
                    done = max(done, e)
                texts[i] = "".join(out) + texts[i][done:]
            cols = list(part.columns)
            cols[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
