"""WHERE clauses: a small expression tree compiled to Column expressions.

A comparison with null is false, also for ``!=``. NOT over comparisons and IN asks that the field be
present; NOT over CONTAINS, LIKE and degrees doesn't. LIKE has no escape character and its
wildcards don't match a line break.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..errors import QueryError


@dataclass(frozen=True)
class Cmp:
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class In:
    field: str
    values: tuple


@dataclass(frozen=True)
class Contains:
    field: str
    text: str


@dataclass(frozen=True)
class Like:
    field: str
    pattern: str


@dataclass(frozen=True)
class Degree:
    incoming: bool
    kind: str | None
    op: str
    value: float


@dataclass(frozen=True)
class Similar:
    text: str
    op: str
    value: float


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def like_regex(pattern: str) -> str:
    """An anchored pattern: ``%`` any run and ``_`` any one character of a line."""
    out = "".join("[^\\n]*" if c == "%" else "[^\\n]" if c == "_" else re.escape(c) for c in pattern)
    return f"^{out}\\z"


def fields_of(rule: Any) -> set[str]:
    if isinstance(rule, (Cmp, In)):
        return {rule.field}
    if isinstance(rule, Not):
        return fields_of(rule.part)
    if isinstance(rule, (And, Or)):
        return set().union(*map(fields_of, rule.parts))
    return set()


def leaves(rule: Any) -> list[Any]:
    if isinstance(rule, Not):
        return leaves(rule.part)
    if isinstance(rule, (And, Or)):
        return [x for p in rule.parts for x in leaves(p)]
    return [rule]


def degree_column(rule: Degree) -> str:
    return f"__{'in' if rule.incoming else 'out'}degree_{rule.kind or ''}"


def _fits(df: DataFrame, field: str, value: Any) -> bool:
    kind = df.schema[field].dataType
    return isinstance(kind, StringType) if isinstance(value, str) else isinstance(kind, NumericType)


def compile_rule(df: DataFrame, rule: Any) -> Column:
    """The predicate over ``df`` as a Column that is never null; a field the table lacks is null everywhere."""
    if rule is None:
        return F.lit(True)
    if isinstance(rule, And):
        out = F.lit(True)
        for p in rule.parts:
            out &= compile_rule(df, p)
        return out
    if isinstance(rule, Or):
        out = F.lit(False)
        for p in rule.parts:
            out |= compile_rule(df, p)
        return out
    if isinstance(rule, Not):
        out = ~compile_rule(df, rule.part)
        for f in sorted(fields_of(rule.part)):
            out &= F.col(f"`{f}`").isNotNull() if f in df.columns else F.lit(False)
        return out
    if isinstance(rule, Degree):
        return OPS[rule.op](F.coalesce(F.col(degree_column(rule)), F.lit(0)), F.lit(rule.value))
    if isinstance(rule, Similar):
        return F.coalesce(OPS[rule.op](F.col("__similarity"), F.lit(rule.value)), F.lit(False))
    if rule.field not in df.columns:
        return F.lit(isinstance(rule, Cmp) and rule.op == "=" and rule.value is None)
    c = F.col(f"`{rule.field}`")
    if isinstance(rule, Cmp):
        if rule.value is None:
            if rule.op not in ("=", "!="):
                raise QueryError(f"{rule.op} with NULL")
            return c.isNull() if rule.op == "=" else c.isNotNull()
        if not _fits(df, rule.field, rule.value):
            return F.lit(False)
        return F.coalesce(OPS[rule.op](c, F.lit(rule.value)), F.lit(False))
    if isinstance(rule, In):
        fit = [v for v in rule.values if v is not None and _fits(df, rule.field, v)]
        return F.coalesce(c.isin(fit), F.lit(False)) if fit else F.lit(False)
    if isinstance(rule, Contains):
        return F.coalesce(c.cast("string").contains(rule.text), F.lit(False))
    if isinstance(rule, Like):
        return F.coalesce(c.cast("string").rlike(like_regex(rule.pattern)), F.lit(False))
    raise QueryError(f"no such predicate: {rule!r}")


def order_by(df: DataFrame, field: str, descending: bool = False, tie: str = "id") -> list[Column]:
    """Numbers: nulls last in both directions. Strings: nulls last ascending and first descending. Ties by id."""
    c = F.col(f"`{field}`") if field in df.columns else F.lit(None).cast("string")
    text = field not in df.columns or isinstance(df.schema[field].dataType, StringType)
    if not descending:
        return [c.asc_nulls_last(), F.col(tie)]
    return [c.desc_nulls_first() if text else c.desc_nulls_last(), F.col(tie)]


def aggregate(df: DataFrame, aggs: list[tuple[str, str | None, str]], by: list[str] | None = None) -> DataFrame:
    """``aggs`` are (function, field, name). Without groups and rows: COUNT, SUM, MIN and MAX are 0, AVG is null."""
    from ..errors import AggregationError

    by = by or []
    for field in [*by, *(f for _, f, _ in aggs if f)]:
        if field not in df.columns:
            raise AggregationError(f"no such field: {field}")
    out = []
    for fn, field, name in aggs:
        c = F.col(f"`{field}`") if field else None
        text = field is not None and isinstance(df.schema[field].dataType, StringType)
        if text and fn in ("SUM", "AVG"):
            raise AggregationError(f"{fn} of the text field {field}")
        one = {
            "COUNT": lambda c=c: F.count(F.lit(1)) if c is None else F.count(c),
            "COUNT_DISTINCT": lambda c=c: F.count_distinct(c),
            "SUM": lambda c=c: F.sum(c.cast("double")),
            "AVG": lambda c=c: F.avg(c.cast("double")),
            "MIN": lambda c=c, text=text: F.min(c if text else c.cast("double")),
            "MAX": lambda c=c, text=text: F.max(c if text else c.cast("double")),
        }[fn]()
        if not by and fn in ("SUM", "MIN", "MAX") and not text:
            one = F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(one)
        out.append(one.alias(name))
    return df.groupBy(*[F.col(f"`{g}`") for g in by]).agg(*out) if by else df.agg(*out)
