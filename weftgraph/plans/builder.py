"""Statements built in Python: ``q.nodes().where(F.score > 5).order_by("score", desc=True).limit(10).dsl()``.

Queries and filters are immutable values; ``dsl()`` gives the statement's text, with every string escaped, and
``execute(engine)`` carries it out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from ..errors import QueryError

_NAME = re.compile(r"[^\W\d]\w*(?:\.\w+)?\Z")
_LOOKUPS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "ne": "!=", "eq": "="}


def name(text: str) -> str:
    if not _NAME.match(text):
        raise QueryError(f"{text!r} isn't a name")
    return text


def string(text: str) -> str:
    marks = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(marks.get(c, c) for c in text) + '"'


@dataclass(frozen=True)
class Time:
    """NOW(), TODAY or YESTERDAY, less a span."""

    text: str

    def ago(self, n: int, unit: str) -> Time:
        if unit not in ("s", "m", "h", "d") or "-" in self.text:
            raise QueryError("one span of s, m, h or d")
        return Time(f"{self.text} - {int(n)}{unit}")


now, today, yesterday = Time("NOW()"), Time("TODAY"), Time("YESTERDAY")


def value(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, Time):
        return v.text
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return format(v, "f") if "e" in repr(v) else repr(v)
    return string(str(v))


@dataclass(frozen=True)
class Filter:
    text: str

    def __and__(self, other: Filter) -> Filter:
        return Filter(f"({self.text}) AND ({other.text})")

    def __or__(self, other: Filter) -> Filter:
        return Filter(f"({self.text}) OR ({other.text})")

    def __invert__(self) -> Filter:
        return Filter(f"NOT ({self.text})")


class Field:
    def __init__(self, text: str) -> None:
        self._name = name(text)

    def _is(self, op: str, v: Any) -> Filter:
        return Filter(f"{self._name} {op} {value(v)}")

    __hash__ = None
    __eq__ = lambda self, v: self._is("=", v)
    __ne__ = lambda self, v: self._is("!=", v)
    __lt__ = lambda self, v: self._is("<", v)
    __le__ = lambda self, v: self._is("<=", v)
    __gt__ = lambda self, v: self._is(">", v)
    __ge__ = lambda self, v: self._is(">=", v)

    def is_null(self) -> Filter:
        return self._is("=", None)

    def not_null(self) -> Filter:
        return self._is("!=", None)

    def in_(self, *values: Any) -> Filter:
        return Filter(f"{self._name} IN ({', '.join(map(value, values))})")

    def not_in(self, *values: Any) -> Filter:
        return ~self.in_(*values)

    def contains(self, text: str) -> Filter:
        return Filter(f"{self._name} CONTAINS {string(text)}")

    def like(self, pattern: str) -> Filter:
        return Filter(f"{self._name} LIKE {string(pattern)}")

    def startswith(self, text: str) -> Filter:
        """By LIKE, which has no escape: ``%`` and ``_`` in ``text`` are wildcards."""
        return self.like(text + "%")

    def similar(self, text: str, threshold: float) -> Filter:
        return Filter(f"SIMILAR({self._name}, {string(text)}) > {value(threshold)}")


class _Fields:
    def __getattr__(self, text: str) -> Field:
        return Field(text)

    __getitem__ = __getattr__


F = _Fields()


def degree(op: str, n: int, kind: str | None = None, incoming: bool = True) -> Filter:
    return Filter(f"{'IN' if incoming else 'OUT'}DEGREE {string(kind) + ' ' if kind else ''}{op} {int(n)}")


def looked_up(**lookups: Any) -> Filter:
    """``field=value`` and ``field__gte=value``, joined by AND."""
    parts = []
    for key, v in lookups.items():
        field, _, how = key.rpartition("__") if key.rpartition("__")[2] in (*_LOOKUPS, "in", "contains", "like") and "__" in key else (key, "", "eq")
        f = Field(field)
        parts.append(f.in_(*v) if how == "in" else f.contains(v) if how == "contains" else f.like(v) if how == "like" else f._is(_LOOKUPS[how], v))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


@dataclass(frozen=True)
class Agg:
    """An aggregate; comparing it gives a HAVING."""

    text: str

    def __gt__(self, v: float) -> str:
        return f"{self.text} > {value(v)}"

    def __ge__(self, v: float) -> str:
        return f"{self.text} >= {value(v)}"

    def __lt__(self, v: float) -> str:
        return f"{self.text} < {value(v)}"

    def __le__(self, v: float) -> str:
        return f"{self.text} <= {value(v)}"


def count(field: str | None = None) -> Agg:
    return Agg("COUNT()" if field is None else f"COUNT DISTINCT({name(field)})")


def aggregate_of(fn: str) -> Callable[[str], Agg]:
    return lambda field: Agg(f"{fn}({name(field)})")


sum_, avg, min_, max_ = (aggregate_of(fn) for fn in ("SUM", "AVG", "MIN", "MAX"))


@dataclass(frozen=True)
class Query:
    """``head``, then its clauses in the order the language asks for."""

    head: str
    clauses: tuple[tuple[str, str], ...] = ()
    order: tuple[str, ...] = ("WHERE", "GROUP BY", "SELECT", "HAVING", "ORDER BY", "LIMIT", "OFFSET")

    def with_(self, clause: str, text: str) -> Query:
        if clause not in self.order:
            raise QueryError(f"{self.head} has no {clause}")
        return replace(self, clauses=(*(c for c in self.clauses if c[0] != clause), (clause, text)))

    def where(self, rule: Filter | None = None, **lookups: Any) -> Query:
        found = [r for r in (Filter(dict(self.clauses)["WHERE"]) if "WHERE" in dict(self.clauses) else None, rule, looked_up(**lookups) if lookups else None) if r is not None]
        out = found[0]
        for r in found[1:]:
            out = out & r
        return self.with_("WHERE", out.text)

    def limit(self, n: int) -> Query:
        return self.with_("LIMIT", str(int(n)))

    def offset(self, n: int) -> Query:
        return self.with_("OFFSET", str(int(n)))

    def tokens(self, n: int) -> Query:
        return self.with_("TOKENS", str(int(n)))

    def at(self, v: Any) -> Query:
        return self.with_("AT", value(v))

    def using(self, reader: str) -> Query:
        return self.with_("USING", string(reader))

    def order_by(self, what: str | Agg, desc: bool = False) -> Query:
        return self.with_("ORDER BY", f"{what.text if isinstance(what, Agg) else name(what)} {'DESC' if desc else 'ASC'}")

    def group_by(self, *fields: str) -> Query:
        return self.with_("GROUP BY", ", ".join(map(name, fields)))

    def select(self, *aggs: Agg) -> Query:
        return self.with_("SELECT", ", ".join(a.text for a in aggs))

    def having(self, text: str) -> Query:
        return self.with_("HAVING", text)

    def pipe(self, fn: Callable[[Query], Any], *args: Any, **more: Any) -> Any:
        return fn(self, *args, **more)

    __or__ = pipe

    def dsl(self) -> str:
        held = dict(self.clauses)
        return " ".join([self.head, *(f"{c} {held[c]}" for c in self.order if c in held)])

    def execute(self, engine: Any) -> Any:
        return engine.execute(self.dsl())


_VERBS: dict[str, Callable[..., Query]] = {}


def register_verb(verb: str) -> Callable[[Callable[..., Query]], Callable[..., Query]]:
    """Add ``q.<verb>(...)``, or replace it."""

    def add(fn: Callable[..., Query]) -> Callable[..., Query]:
        _VERBS[verb] = fn
        return fn

    return add


def _fields(given: dict[str, Any]) -> str:
    return "".join(f" {name(k)} = {value(v)}" for k, v in given.items())


def _vector(v: list[float]) -> str:
    return "[" + ", ".join(value(float(x)) for x in v) + "]"


def _walk(verb: str, of: str) -> Callable[..., Query]:
    return lambda start, depth: Query(f"{verb} {of} {string(start)} DEPTH {int(depth)}", order=("LIMIT", "WHERE") if verb == "RECALL" else ("WHERE", "LIMIT"))


def _path(verb: str) -> Callable[..., Query]:
    return lambda a, b, most=None: Query(f"{verb} FROM {string(a)} TO {string(b)}" + (f" MAX_DEPTH {value(most)}" if most is not None else ""), order=("WHERE",))


class Builder:
    """``q``: one method for each verb."""

    def __getattr__(self, verb: str) -> Callable[..., Query]:
        if verb in _VERBS:
            return _VERBS[verb]
        raise AttributeError(f"no such verb: {verb}")


for _verb, _of in (("TRAVERSE", "FROM"), ("SUBGRAPH", "FROM"), ("RECALL", "FROM"), ("ANCESTORS", "OF"), ("DESCENDANTS", "OF")):
    _VERBS[_verb.lower()] = _walk(_verb, _of)
for _verb in ("PATH", "PATHS", "SHORTEST PATH", "DISTANCE", "WEIGHTED SHORTEST PATH", "WEIGHTED DISTANCE"):
    _VERBS[_verb.lower().replace(" ", "_")] = _path(_verb)


@register_verb("node")
def _node(ident: str, document: bool = False) -> Query:
    return Query(f"NODE {string(ident)}" + (" WITH DOCUMENT" if document else ""), order=())


@register_verb("nodes")
def _nodes() -> Query:
    return Query("NODES", order=("WHERE", "ORDER BY", "LIMIT", "OFFSET"))


@register_verb("edges")
def _edges(source: str | None = None, target: str | None = None) -> Query:
    return Query(f"EDGES {'FROM' if source is not None else 'TO'} {string(source if source is not None else target or '')}", order=("WHERE", "LIMIT"))


@register_verb("count")
def _count(what: str = "NODES") -> Query:
    return Query(f"COUNT {name(what.upper())}", order=("WHERE",))


@register_verb("aggregate")
def _aggregate() -> Query:
    return Query("AGGREGATE NODES", order=("WHERE", "GROUP BY", "SELECT", "HAVING", "ORDER BY", "LIMIT"))


@register_verb("common_neighbors")
def _common(a: str, b: str) -> Query:
    return Query(f"COMMON NEIGHBORS OF {string(a)} AND {string(b)}", order=("WHERE",))


@register_verb("match")
def _match(*steps: Any) -> Query:
    """Steps and edge kinds in turn: ``match("a", "next", ("m", F.score > 1))``; a step is an id, or a name with a filter or None."""
    out = []
    for i, s in enumerate(steps):
        if i % 2:
            out.append("-[]->" if s is None else f"-[kind = {string(s)}]->")
        elif isinstance(s, tuple):
            out.append(f"({name(s[0])}" + (f" WHERE {s[1].text})" if s[1] is not None else ")"))
        else:
            out.append(f"({string(s)})")
    return Query("MATCH " + " ".join(out), order=("LIMIT",))


@register_verb("similar")
def _similar(to: Any = None, node: str | None = None) -> Query:
    target = f"NODE {string(node)}" if node is not None else string(to) if isinstance(to, str) else _vector(to)
    return Query(f"SIMILAR TO {target}", order=("LIMIT", "WHERE"))


@register_verb("lexical")
def _lexical(text: str) -> Query:
    return Query(f"LEXICAL SEARCH {string(text)}", order=("LIMIT", "WHERE"))


@register_verb("remember")
def _remember(text: str) -> Query:
    return Query(f"REMEMBER {string(text)}", order=("AT", "TOKENS", "LIMIT", "WHERE"))


@register_verb("answer")
def _answer(text: str) -> Query:
    return Query(f"ANSWER {string(text)}", order=("AT", "TOKENS", "LIMIT", "WHERE", "USING"))


@register_verb("what_if_retract")
def _what_if(ident: str) -> Query:
    return Query(f"WHAT IF RETRACT {string(ident)}", order=())


def _put(verb: str) -> Callable[..., Query]:
    def build(ident: str | None = None, vector: list[float] | None = None, document: str | None = None, expires_in: str | None = None, event_at: Any = None, **fields: Any) -> Query:
        text = f"{verb} NODE {'AUTO' if ident is None else string(ident)}{_fields(fields)}"
        text += f" VECTOR {_vector(vector)}" if vector is not None else ""
        if expires_in is not None and not re.fullmatch(r"\d+[smhd]", expires_in):
            raise QueryError(f"{expires_in!r} isn't a span")
        text += f" EXPIRES IN {expires_in}" if expires_in is not None else ""
        text += f" EVENT_AT {value(event_at)}" if event_at is not None else ""
        return Query(text + (f" DOCUMENT {string(document)}" if document is not None else ""), order=())

    return build


_VERBS["create_node"], _VERBS["upsert_node"] = _put("CREATE"), _put("UPSERT")


@register_verb("create_edge")
def _create_edge(src: str, dst: str, **fields: Any) -> Query:
    return Query(f"CREATE EDGE {string(src)} -> {string(dst)}{_fields(fields)}", order=())


@register_verb("update_edge")
def _update_edge(src: str, dst: str, **fields: Any) -> Query:
    return Query(f"UPDATE EDGE {string(src)} -> {string(dst)} SET{_fields(fields)}", order=("WHERE",))


@register_verb("update_node")
def _update_node(ident: str, **fields: Any) -> Query:
    return Query(f"UPDATE NODE {string(ident)} SET{_fields(fields)}", order=())


@register_verb("update_nodes")
def _update_nodes(rule: Filter, **fields: Any) -> Query:
    return Query(f"UPDATE NODES WHERE {rule.text} SET{_fields(fields)}", order=())


@register_verb("delete_node")
def _delete_node(ident: str) -> Query:
    return Query(f"DELETE NODE {string(ident)}", order=())


@register_verb("delete_nodes")
def _delete_nodes(rule: Filter) -> Query:
    return Query(f"DELETE NODES WHERE {rule.text}", order=())


@register_verb("delete_edge")
def _delete_edge(src: str, dst: str) -> Query:
    return Query(f"DELETE EDGE {string(src)} -> {string(dst)}", order=("WHERE",))


@register_verb("increment")
def _increment(ident: str, field: str, by: float = 1) -> Query:
    return Query(f"INCREMENT NODE {string(ident)} {name(field)} BY {value(by)}", order=())


@register_verb("merge")
def _merge(source: str, target: str) -> Query:
    return Query(f"MERGE NODE {string(source)} INTO {string(target)}", order=())


@register_verb("believe")
def _believe(ident: str, confidence: float | None = None, source: str | None = None, **fields: Any) -> Query:
    text = f"ASSERT {string(ident)}{_fields(fields)}"
    text += f" CONFIDENCE {value(confidence)}" if confidence is not None else ""
    return Query(text + (f" SOURCE {string(source)}" if source is not None else ""), order=())


@register_verb("retract")
def _retract(ident: str, reason: str | None = None) -> Query:
    return Query(f"RETRACT {string(ident)}" + (f" REASON {string(reason)}" if reason is not None else ""), order=())


@register_verb("forget")
def _forget(ident: str) -> Query:
    return Query(f"FORGET NODE {string(ident)}", order=())


@register_verb("connect")
def _connect(ident: str, threshold: float | None = None) -> Query:
    return Query(f"CONNECT NODE {string(ident)}" + (f" THRESHOLD {value(threshold)}" if threshold is not None else ""), order=())


@register_verb("ingest")
def _ingest(path: str, as_id: str | None = None, kind: str | None = None) -> Query:
    return Query(f"INGEST {string(path)}" + (f" AS {string(as_id)}" if as_id else "") + (f" KIND {string(kind)}" if kind else ""), order=())


@register_verb("sys")
def _sys(*words: str) -> Query:
    return Query("SYS " + " ".join(w if re.fullmatch(r"[A-Z_]+", w) else string(w) for w in words), order=("WHERE", "LIMIT"))


q = Builder()
