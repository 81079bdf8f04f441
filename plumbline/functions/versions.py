"""Versions and ranges as Column expressions.

A version is a struct that Spark compares in precedence order: numbers, then release before nothing, then pre-release
identifiers (numeric below text, a shorter list below a longer one with the same start). Invalid text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"(?:[0-9]+|[*xX])"
_MOST = "18446744073709551615"
_NUM = "decimal(20,0)"


def _number(text: Column) -> Column:
    wide = text.try_cast("decimal(38,0)")
    return F.when(text.rlike(r"\A[0-9]+\z") & (wide <= F.lit(_MOST).cast("decimal(38,0)")), wide.cast(_NUM))


def _plain(major: Column, minor: Column, patch: Column) -> Column:
    none = F.lit(None).cast(f"array<struct<kind:int,num:{_NUM},text:string>>")
    return _struct(major, minor, patch, F.lit(1), F.coalesce(none, F.array().cast(f"array<struct<kind:int,num:{_NUM},text:string>>")))


def _struct(major, minor, patch, release, pre) -> Column:
    return F.struct(major.cast(_NUM).alias("major"), minor.cast(_NUM).alias("minor"), patch.cast(_NUM).alias("patch"), release.cast("int").alias("release"), pre.alias("pre"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside lambdas Spark shares no common subexpressions."""
    return F.transform(F.array(value), body)[0]


def components(c: Column) -> Column:
    """struct(major, minor, patch: null if absent or a wildcard; parts; release; pre), or null if invalid."""
    text = F.split_part(F.regexp_replace(F.regexp_replace(c, r"\A\s+|\s+\z", ""), r"\A[vV]", ""), F.lit("+"), F.lit(1))
    return _let(text, lambda t: _let(F.struct(t.alias("text"), F.split_part(t, F.lit("-"), F.lit(1)).alias("core")), lambda x: _parsed(x["text"], x["core"])))


def _parsed(text: Column, core: Column) -> Column:
    parts = F.split(core, r"\.")
    has_pre = F.contains(text, F.lit("-"))

    def ident(x: Column) -> Column:
        n = _number(x)
        return F.struct(F.when(n.isNull(), 1).otherwise(0).alias("kind"), F.coalesce(n, F.lit(0).cast(_NUM)).alias("num"), F.when(n.isNull(), x).otherwise("").alias("text"))

    pre = F.transform(F.split(F.substring(text, F.length(core) + 2, F.length(text)), r"\."), ident)
    wild = lambda i: F.try_element_at(parts, F.lit(i)).isin("*", "x", "X")
    part = lambda i: F.when(~wild(i), _number(F.try_element_at(parts, F.lit(i))))
    fits = lambda i: (F.size(parts) < i) | wild(i) | part(i).isNotNull()
    valid = core.rlike(rf"\A{_PART}(?:\.{_PART}){{0,2}}\z") & fits(1) & fits(2) & fits(3)
    none = F.array().cast(f"array<struct<kind:int,num:{_NUM},text:string>>")
    return F.when(
        valid,
        F.struct(
            part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), F.size(parts).alias("parts"),
            F.when(has_pre, 0).otherwise(1).alias("release"), F.when(has_pre, pre).otherwise(none).alias("pre"),
        ),
    )


def _full(k: Column) -> Column:
    zero = F.lit(0).cast(_NUM)
    return _struct(F.coalesce(k["major"], zero), F.coalesce(k["minor"], zero), F.coalesce(k["patch"], zero), k["release"], k["pre"])


def parse_version(c: Column) -> Column:
    """The comparable version struct, or null. Plain x.y.z text takes a short way."""
    plain = c.rlike(r"\A[0-9]{1,18}\.[0-9]{1,18}\.[0-9]{1,18}\z")
    part = lambda i: F.split_part(c, F.lit("."), F.lit(i)).cast("bigint")
    return F.when(plain, _plain(part(1), part(2), part(3))).otherwise(_let(components(c), lambda k: F.when(k.isNotNull(), _full(k))))


def _comparators(token: Column) -> Column:
    """array(struct(op, ver)) of one range token, or null if it is invalid. Caret, tilde and bare forms give two bounds."""
    op = F.regexp_extract(token, r"\A(>=|<=|!=|==|>|<|=|\^|~)", 1)
    bound = F.struct(op.alias("op"), components(F.substring(token, F.length(op) + 1, F.length(token))).alias("k"))
    return _let(bound, lambda x: _bounds(x["op"], x["k"]))


def _bounds(op: Column, k: Column) -> Column:
    zero, one = F.lit(0).cast(_NUM), F.lit(1).cast(_NUM)
    major, minor, patch = k["major"], k["minor"], k["patch"]
    m, n, p = F.coalesce(major, zero), F.coalesce(minor, zero), F.coalesce(patch, zero)
    pair = lambda o, v: F.struct(F.lit(o).alias("op"), v.alias("ver"))
    any_version = F.array(pair(">=", _plain(zero, zero, zero)))
    caret = (
        F.when(m > 0, _plain(m + one, zero, zero)).when(n > 0, _plain(zero, n + one, zero)).when(p > 0, _plain(zero, zero, p + one))
        .when(minor.isNull(), _plain(one, zero, zero)).when(patch.isNull(), _plain(zero, one, zero)).otherwise(_plain(zero, zero, one))
    )
    step = F.when(minor.isNotNull(), _plain(m, n + one, zero)).otherwise(_plain(m + one, zero, zero))
    exact = (k["parts"] == 3) & major.isNotNull() & minor.isNotNull() & patch.isNotNull()
    simple = F.array(F.struct(F.when(op == "==", "=").otherwise(op).alias("op"), _full(k).alias("ver")))
    return F.when(k.isNull(), F.lit(None)).when(op.isin(">=", "<=", "!=", "==", ">", "<", "="), simple).when((op == "") & exact, F.array(pair("=", _full(k)))).when(
        major.isNull(), any_version
    ).when(op == "^", F.array(pair(">=", _full(k)), pair("<", caret))).when(op == "~", F.array(pair(">=", _full(k)), pair("<", step))).otherwise(
        F.array(pair(">=", _plain(m, n, zero)), pair("<", step))
    )


def compile_range(c: Column) -> Column:
    """array of alternatives, each an array of struct(op, ver); null if the range is invalid. Compile rules once, then match rows."""
    zero = F.lit(0).cast(_NUM)

    def group(text: Column) -> Column:
        tokens = F.filter(F.split(F.replace(text, F.lit(","), F.lit(" ")), r"\s+"), lambda t: t != "")
        anything = F.array(F.struct(F.lit(">=").alias("op"), _plain(zero, zero, zero).alias("ver")))
        return _let(
            F.transform(tokens, _comparators),
            lambda every: F.when(F.exists(every, lambda x: x.isNull()), F.lit(None)).when(F.size(every) == 0, anything).otherwise(F.flatten(every)),
        )

    return _let(F.transform(F.split(c, r"\|\|"), group), lambda groups: F.when(~F.exists(groups, lambda g: g.isNull()), groups))


def matches(compiled: Column, version: Column) -> Column:
    """Whether a version struct lies in a compiled range (null in either gives false)."""

    def holds(c: Column) -> Column:
        op, ver = c["op"], c["ver"]
        return (
            F.when(op == "=", version == ver).when(op == "!=", version != ver).when(op == ">", version > ver)
            .when(op == ">=", version >= ver).when(op == "<", version < ver).otherwise(version <= ver)
        )

    return F.coalesce(version.isNotNull() & F.exists(compiled, lambda g: F.forall(g, holds)), F.lit(False))


def version_satisfies(range_col: Column, version_col: Column) -> Column:
    """Empty and ``*`` ranges hold for all; invalid ranges or versions for none."""
    return range_col.isin("", "*") | matches(compile_range(range_col), parse_version(version_col))


def segments(c: Column) -> Column:
    """The fall-back order of versions that are no semantic versions: leading numbers of segments, then their count."""
    parts = F.split(F.regexp_replace(c, r"\Av", ""), r"\.")
    return F.transform(parts, lambda p: F.coalesce(F.regexp_extract(p, r"\A([0-9]+)", 1).try_cast("bigint"), F.lit(0)))


def newer(a: Column, b: Column) -> Column:
    """Whether version text a is above b."""
    return _let(F.struct(parse_version(a).alias("a"), parse_version(b).alias("b")), lambda x: _newer(x["a"], x["b"], a, b))


def _newer(va: Column, vb: Column, a: Column, b: Column) -> Column:
    return F.when(va.isNotNull() & vb.isNotNull(), va > vb).otherwise(segments(a) > segments(b))


def is_patch_step(old: Column, new: Column) -> Column:
    """Both strict three-part versions with the same major and minor and another patch."""
    strict = r"\A[vV]?([0-9]+)\.([0-9]+)\.([0-9]+)(?:[-+].*)?\z"
    both = old.rlike(strict) & new.rlike(strict)
    same = lambda i: F.regexp_extract(old, strict, i) == F.regexp_extract(new, strict, i)
    return both & same(1) & same(2) & ~same(3)


def normalize_pypi(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")
