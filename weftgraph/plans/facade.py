"""Plain calls over ``Engine``: requests and replies as dictionaries, and the few calls a research tool needs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..errors import QueryError
from .builder import q
from .engine import Engine

#: A reply holds at most this many rows, and says whether there were more.
REPLY_ROWS = 10_000


def reply(out: DataFrame | None) -> dict[str, Any]:
    if out is None:
        return {"ok": True, "columns": [], "rows": [], "more": False}
    rows = [r.asDict(recursive=True) for r in out.limit(REPLY_ROWS + 1).collect()]
    return {"ok": True, "columns": out.columns, "rows": rows[:REPLY_ROWS], "more": len(rows) > REPLY_ROWS}


def handle(engine: Engine, request: dict[str, Any]) -> dict[str, Any]:
    """``{"query": text}`` or ``{"queries": [texts]}``; a statement's error is part of its reply."""
    try:
        if "queries" in request:
            return {"ok": True, "results": [handle(engine, {"query": x}) for x in request["queries"]]}
        if not isinstance(request.get("query"), str):
            raise QueryError("query expected")
        return reply(engine.execute(request["query"]))
    except QueryError as e:
        return {"ok": False, "error": str(e), "type": type(e).__name__}


class Research:
    """Ingest, search, answer, explore, relate and forget."""

    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def ingest(self, path: str, kind: str | None = None) -> dict[str, Any]:
        return reply(q.ingest(path, kind=kind).execute(self.engine))

    def search(self, text: str, limit: int = 10) -> dict[str, Any]:
        return reply(q.remember(text).limit(limit).execute(self.engine))

    def answer(self, text: str, limit: int = 10) -> dict[str, Any]:
        return reply(q.answer(text).limit(limit).execute(self.engine))

    def explore(self, ident: str, depth: int = 2) -> dict[str, Any]:
        return reply(q.traverse(ident, depth).execute(self.engine))

    def relate(self, src: str, dst: str, kind: str = "related") -> dict[str, Any]:
        return reply(q.create_edge(src, dst, kind=kind).execute(self.engine))

    def forget(self, ident: str) -> dict[str, Any]:
        return reply(q.forget(ident).execute(self.engine))

    def gaps(self) -> dict[str, Any]:
        """Nodes without an edge."""
        from .builder import degree

        return reply(q.nodes().where(degree("=", 0) & degree("=", 0, incoming=False)).execute(self.engine))
