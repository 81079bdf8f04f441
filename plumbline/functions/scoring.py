"""Severity, CVSS and verdict expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BLOCK, PROMPT, REVIEW, SEVERITIES, VERDICTS


def severity_rank(c: Column) -> Column:
    """0 info to 4 critical; anything else is info."""
    return reduce(lambda e, i: e.when(F.lower(c) == SEVERITIES[i], i), range(2, 5), F.when(F.lower(c) == "low", 1)).when(F.lower(c) == "moderate", 2).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def verdict_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VERDICTS)), rank + 1)


def score_verdict(score: Column) -> Column:
    """Verdict rank of a score."""
    return F.when(score >= BLOCK, 3).when(score >= PROMPT, 2).when(score >= REVIEW, 1).otherwise(0)


def advisory_verdict(severity: Column) -> Column:
    """Verdict rank of a severity rank."""
    return F.when(severity >= 3, 3).when(severity == 2, 2).when(severity == 1, 1).otherwise(0)


def downgrade(verdict: Column) -> Column:
    return F.greatest(verdict - 1, F.lit(0))


# Metric weights of the CVSS v3 base score.
_METRICS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0}, "I": {"H": 0.56, "L": 0.22, "N": 0.0}, "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}


def cvss_base_score(vector: Column) -> Column:
    """The v3.x base score; null for other versions and for vectors with a missing metric."""
    m = F.str_to_map(vector, F.lit("/"), F.lit(":"))
    get = lambda k: F.try_element_at(m, F.lit(k))
    weigh = lambda k: reduce(lambda e, x: e.when(get(k) == x[0], F.lit(x[1])), list(_METRICS[k].items())[1:], F.when(get(k) == next(iter(_METRICS[k])), F.lit(next(iter(_METRICS[k].values())))))
    changed = get("S") == "C"
    pr = F.when(get("PR") == "N", F.lit(0.85)).when(get("PR") == "L", F.when(changed, F.lit(0.68)).otherwise(F.lit(0.62))).when(get("PR") == "H", F.when(changed, F.lit(0.5)).otherwise(F.lit(0.27)))
    base = F.lit(1.0) - (F.lit(1.0) - weigh("C")) * (F.lit(1.0) - weigh("I")) * (F.lit(1.0) - weigh("A"))
    impact = F.when(changed, F.lit(7.52) * (base - F.lit(0.029)) - F.lit(3.25) * F.pow(base - F.lit(0.02), F.lit(15.0))).otherwise(F.lit(6.42) * base)
    exploit = F.lit(8.22) * weigh("AV") * weigh("AC") * pr * weigh("UI")
    raw = F.when(changed, F.least(F.lit(1.08) * (impact + exploit), F.lit(10.0))).otherwise(F.least(impact + exploit, F.lit(10.0)))
    ok = vector.startswith("CVSS:3.") & (F.size(F.split(vector, "/")) >= 9) & get("S").isin("U", "C") & pr.isNotNull()
    for k in _METRICS:
        ok = ok & weigh(k).isNotNull()
    return F.when(F.coalesce(ok, F.lit(False)), F.when(impact <= 0, F.lit(0.0)).otherwise(F.ceil(raw * F.lit(10.0)) / F.lit(10.0)))


def cvss_rank(score: Column) -> Column:
    return F.when(score >= 9.0, 4).when(score >= 7.0, 3).when(score >= 4.0, 2).when(score > 0.0, 1).otherwise(0)
