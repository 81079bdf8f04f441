"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans.oracles import ORACLES
from .plans.queries import QUERIES

FLAGSHIP = "dependency_verdicts"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
