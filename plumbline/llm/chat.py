"""Chat formatting by schema fingerprints.

A record is a JSON object. The set of its nested field paths (list positions dropped) is hashed; the hash selects a
declarative mapping, which turns prompt, instruction and message layouts into canonical turns (role, text). A path set
not declared beforehand is resolved once (the first mapping whose needed paths it has) and remembered by its hash.

Template: ``### role: text</turn>`` and a line feed for each turn. Inside roles and texts a backslash becomes ``\\b``,
``<`` becomes ``\\l``, ``#`` becomes ``\\h`` and, in roles only, ``:`` becomes ``\\c``; so no control string survives
in them, and reading back is exact. The loss mask is a list of spans (code points of the formatted text).

Nulls: a null text, role or field is empty. A record that is null, not an object, nested too deeply to be read, or of no
known layout yields no turns and an empty formatted text; so does a list path that holds no list, and a list's item that
is no object gives an empty turn. A lone surrogate becomes U+FFFD. Ties of turn numbers are ordered by role, then text.
Repeated rows are turns of their own. Texts of any length are read whole; an empty table gives no rows; extra columns are
ignored. A conversation is one training record and has to fit a row; nothing else is gathered by key.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Mappings in order of preference: each part is (list path or None, role: constant "=..." or path, text paths joined by a line feed).
LAYOUTS: list[tuple[str, list[tuple[str | None, str, tuple[str, ...]]]]] = [
    ("messages", [("messages[]", "role", ("content",))]),
    ("from_value", [("conversations[]", "from", ("value",))]),
    ("turns", [("turns[]", "role", ("text",))]),
    ("instruction_input", [(None, "=user", ("instruction", "input")), (None, "=assistant", ("output",))]),
    ("instruction", [(None, "=user", ("instruction",)), (None, "=assistant", ("output",))]),
    ("system_prompt", [(None, "=system", ("system",)), (None, "=user", ("prompt",)), (None, "=assistant", ("response",))]),
    ("prompt_response", [(None, "=user", ("prompt",)), (None, "=assistant", ("response",))]),
    ("prompt_completion", [(None, "=user", ("prompt",)), (None, "=assistant", ("completion",))]),
    ("question_answer", [(None, "=user", ("question",)), (None, "=assistant", ("answer",))]),
]
#: Other names for canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def needed(parts) -> frozenset[str]:
    """The leaf paths that a mapping reads."""
    out = set()
    for at, role, texts in parts:
        stem = f"{at}." if at else ""
        out |= {stem + t for t in texts} | ({stem + role} if role[0] != "=" else set())
    return frozenset(out)


def paths(value) -> set[str]:
    """Leaf field paths of a record; an empty list counts as its own path."""
    out, left = set(), [("", value)]
    while left:
        stem, value = left.pop()
        if isinstance(value, dict):
            left += [(f"{stem}.{k}" if stem else k, v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            left += [(f"{stem}[]", v) for v in value]
        else:
            out.add(f"{stem}[]" if isinstance(value, list) else stem)
    return out


def fingerprint(found) -> int:
    """A stable 64-bit hash of a path set."""
    joined = "\n".join(sorted(found)).encode("utf-8", "surrogatepass")
    return (zlib.crc32(joined) << 31) | (zlib.crc32(joined[::-1]) >> 1)


KNOWN = {fingerprint(needed(parts)): name for name, parts in LAYOUTS}
_PARTS = dict(LAYOUTS)
MOST_REMEMBERED = 1 << 14
_SURROGATE = re.compile("[\ud800-\udfff]")


def select_layout(found: set[str], memory: dict[int, str]) -> tuple[int, str]:
    """The fingerprint of a path set and the layout's name, '' if none fits."""
    key = fingerprint(found)
    if key not in memory:
        if len(memory) >= MOST_REMEMBERED:  # what is remembered never changes what is chosen
            memory.clear()
        memory[key] = next((name for name, parts in LAYOUTS if needed(parts) <= found or all(at and at in found for at, _, _ in parts)), "")
    return key, memory[key]


def _string(value) -> str:
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _SURROGATE.sub("\ufffd", text)


def _at(record, path: str):
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def canonical_turns(record, layout: str) -> list[tuple[str, str]]:
    out = []
    for at, role, texts in _PARTS.get(layout, ()):
        items = _at(record, at[:-2]) if at else [record]
        for item in items if isinstance(items, list) else ():
            name = role[1:] if role[0] == "=" else _string(_at(item, role))
            fields = [_string(_at(item, t)) for t in texts]
            out.append((ROLES.get(name, name), "\n".join([fields[0], *(x for x in fields[1:] if x)])))
    return out


def escape(text: str) -> str:
    return text.replace("\\", "\\b").replace("<", "\\l").replace("#", "\\h")


def unescape(text: str) -> str:
    return text.replace("\\c", ":").replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\") if "\\" in text else text


def render(turns: list[tuple[str, str]], loss_roles=("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role).replace(':', chr(92) + 'c')}: ", escape(text)
        out += (head, body, "</turn>\n")
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + 8
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds."""
    out = []
    for turn in formatted.split("</turn>\n")[:-1]:
        role, _, body = turn[4:].partition(": ")
        out.append((unescape(role), unescape(body)))
    return out


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn gathered into one message-layout record a conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    messages = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return conversations.groupBy("conv_id").agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def read_record(raw: str | None, memory: dict[int, str]) -> tuple[int, str, str, list[tuple[int, int]]]:
    """Fingerprint, layout, formatted text and loss spans of a JSON record; (0, '', '', []) where it cannot be read."""
    try:
        record = json.loads(raw) if raw else None
        if not isinstance(record, dict):
            return 0, "", "", []
        key, name = select_layout(paths(record), memory)
        return key, name, *render(canonical_turns(record, name))
    except (ValueError, RecursionError):
        return 0, "", "", []


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """(id, fingerprint, layout, formatted, loss_spans) for each JSON record."""
    kind = records.schema[id_col].dataType.simpleString()
    out = f"{id_col} {kind}, fingerprint long, layout string, formatted string, loss_spans array<struct<start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = dict(KNOWN)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in tk.slices(batches, record_col):
            got = [read_record(raw, memory) for raw in batch.column(1).to_pylist()]
            prints, names, texts, masks = (list(x) for x in zip(*got, strict=True))
            masks = [[{"start": a, "end": b} for a, b in spans] for spans in masks]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(masks, span)],
                [id_col, "fingerprint", "layout", "formatted", "loss_spans"],
            )

    return records.select(id_col, record_col).mapInArrow(run, out)


def digest_formatted(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests read back from formatted texts and their loss spans."""
    import hashlib

    kind = formatted.schema[id_col].dataType.simpleString()
    out = f"{id_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fingerprint long, layout string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, "formatted"):
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), batch.column(3), batch.column(4)],
                [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "fingerprint", "layout"],
            )

    return formatted.select(id_col, "formatted", "loss_spans", "fingerprint", "layout").mapInArrow(run, out)
