from __future__ import annotations

import re

import __spark_entry__ as entry


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert [sum(bool(re.match(rf"op{n}_", x)) for x in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and "op4_chat_formatting" in entry.oracle_sql()


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for path in (root / "plumbline").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
