"""Shared intermediate tables: every executor and the driver see them, so lost executors cost nothing but a reread."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..shared import drop_table, shared_folder, write_table

__all__ = ["cut", "drop_table", "release", "shared_folder", "write_table"]
_written: dict[int, tuple[DataFrame, str]] = {}


def cut(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its lineage cut by a written table, in folders by the columns ``by``."""
    out, path = write_table(df, name, by)
    _written[id(out)] = (out, path)
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        found = _written.pop(id(t), None)
        if found:
            drop_table(t.sparkSession, found[1])
