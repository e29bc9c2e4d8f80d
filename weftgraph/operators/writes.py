"""Mutations as copy-on-write: every function returns the new table or catalog and changes nothing."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..errors import NodeExists, NodeNotFound


def _typed(value: Any) -> tuple[Any, str]:
    if isinstance(value, bool):
        return int(value), "long"
    if isinstance(value, int):
        return value, "long"
    if isinstance(value, float):
        return value, "double"
    return (None if value is None else str(value)), "string"


def _is(ident: str) -> Column:
    return F.col("id") == ident


def exists(nodes: DataFrame, ident: str) -> bool:
    return nodes.filter(_is(ident)).limit(1).count() > 0


def one_row(nodes: DataFrame, ident: str, kind: str, fields: dict[str, Any]) -> DataFrame:
    typed = {k: _typed(v) for k, v in fields.items()}
    schema = "id string, kind string" + "".join(f", `{k}` {t}" for k, (_, t) in typed.items())
    return nodes.sparkSession.createDataFrame([(ident, kind, *[v for v, _ in typed.values()])], schema)


def widened(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Union by name; a long column that meets a double becomes double, any other clash is cast to the table's type or null."""
    kinds, fresh = dict(nodes.dtypes), dict(rows.dtypes)
    for c in set(kinds) & set(fresh):
        if kinds[c] != fresh[c]:
            if {kinds[c], fresh[c]} <= {"int", "bigint", "float", "double"}:
                wide = "double" if "double" in (kinds[c], fresh[c]) or "float" in (kinds[c], fresh[c]) else "bigint"
                nodes, rows = nodes.withColumn(c, F.col(f"`{c}`").cast(wide)), rows.withColumn(c, F.col(f"`{c}`").cast(wide))
            else:
                rows = rows.withColumn(c, F.expr(f"try_cast(`{c}` AS {kinds[c]})"))
    return nodes.unionByName(rows, allowMissingColumns=True)


def create(nodes: DataFrame, ident: str, kind: str, fields: dict[str, Any], now_ms: int) -> DataFrame:
    if exists(nodes, ident):
        raise NodeExists(ident)
    return widened(nodes, one_row(nodes, ident, kind, {**fields, "__created_at__": now_ms, "__updated_at__": now_ms}))


def update_where(nodes: DataFrame, rule: Column, fields: dict[str, Any], now_ms: int) -> DataFrame:
    """Set fields where ``rule`` holds; a new field is added, a long field that gets a double is widened."""
    hit, kinds = F.coalesce(rule, F.lit(False)), dict(nodes.dtypes)
    out = nodes.withColumn("__hit", hit)
    for name, value in {**fields, "__updated_at__": now_ms}.items():
        v, t = _typed(value)
        new = F.lit(v).cast(t)
        old = F.col(f"`{name}`") if name in kinds else F.lit(None).cast(t)
        if name in kinds and kinds[name] in ("int", "bigint") and t == "double":
            old = old.cast("double")
        elif name in kinds and kinds[name] != t:
            new = F.lit(v).cast("string").try_cast(kinds[name]) if t == "string" else new.cast(kinds[name])
        out = out.withColumn(name, F.when(F.col("__hit"), new).otherwise(old))
    return out.drop("__hit")


def upsert(nodes: DataFrame, ident: str, kind: str, fields: dict[str, Any], now_ms: int) -> DataFrame:
    """Update, or create; an existing node keeps its kind."""
    return update_where(nodes, _is(ident), fields, now_ms) if exists(nodes, ident) else create(nodes, ident, kind, fields, now_ms)


def upsert_rows(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Bulk upsert by id: given fields win, the others stay; one shuffle of both tables on the id."""
    fresh = rows.select("id", *[F.col(f"`{c}`").alias(f"__new_{c}") for c in rows.columns if c != "id"])
    joined = nodes.join(fresh, "id", "full_outer")
    names = list(dict.fromkeys([*nodes.columns, *rows.columns]))
    pick = []
    for c in names:
        if c == "id":
            pick.append(F.col("id"))
        elif c == "kind":
            pick.append(F.coalesce("kind", *(["__new_kind"] if "kind" in rows.columns else [])).alias(c))
        else:
            both = [x for x in (f"__new_{c}" if c in rows.columns else None, c if c in nodes.columns else None) if x]
            pick.append(F.coalesce(*[F.col(f"`{x}`") for x in both]).alias(c))
    return joined.select(pick)


def increment(nodes: DataFrame, ident: str, name: str, by: float) -> DataFrame:
    if dict(nodes.dtypes).get(name) == "string":
        raise TypeError(f"{name} is text")
    old = F.coalesce(F.col(f"`{name}`"), F.lit(0)) if name in nodes.columns else F.lit(0)
    keep = F.col(f"`{name}`") if name in nodes.columns else F.lit(None)
    return nodes.withColumn(name, F.when(_is(ident), old + F.lit(by)).otherwise(keep))


def delete_nodes(catalog: Catalog, ids: DataFrame) -> Catalog:
    """Without the nodes of ``ids`` (id), their edges, vectors and documents."""
    gone = ids.select("id").distinct()
    less = lambda df, c: df if df is None else df.join(gone.withColumnRenamed("id", c), c, "left_anti").select(df.columns)
    edges = less(less(catalog.edges, "src"), "dst")
    return replace(catalog, nodes=less(catalog.nodes, "id"), edges=edges, vectors=less(catalog.vectors, "id"), documents=less(catalog.documents, "id"))


def merge_node(catalog: Catalog, source: str, target: str, now_ms: int) -> Catalog:
    """The target keeps its values and gets the source's where it has none; edges are rewired, one for each (src, dst, kind)."""
    nodes = catalog.nodes
    for ident in (source, target):
        if not exists(nodes, ident):
            raise NodeNotFound(ident)
    names = [c for c in nodes.columns if c not in ("id", "kind")]
    gaps = nodes.filter(_is(source)).select(F.lit(target).alias("id"), *[F.col(f"`{c}`").alias(f"__s_{c}") for c in names]).limit(1)
    hit = nodes.filter(_is(target)).join(F.broadcast(gaps), "id")
    now = {"__updated_at__": F.lit(now_ms).cast("long")}
    merged = hit.select("id", "kind", *[now.get(c, F.coalesce(f"`{c}`", f"`__s_{c}`")).alias(c) for c in names])
    rest = nodes.filter((F.col("id") != source) & (F.col("id") != target))
    swap = lambda c: F.when(F.col(c) == source, target).otherwise(F.col(c)).alias(c)
    edges = catalog.edges
    moved = edges.select(*[swap(c) if c in ("src", "dst") else F.col(c) for c in edges.columns]).dropDuplicates(["src", "dst", "kind"])
    return replace(catalog, nodes=rest.unionByName(merged), edges=moved)


def create_edge(catalog: Catalog, src: str, dst: str, kind: str = "default", weight: float = 1.0, data: dict[str, Any] | None = None) -> Catalog:
    """Add an edge between existing nodes; one of the same ends and kind is left as it is."""
    for ident in (src, dst):
        if not exists(catalog.nodes, ident):
            raise NodeNotFound(ident)
    edges = catalog.edges
    row = edges.sparkSession.createDataFrame([(src, dst, kind, float(weight), {k: str(v) for k, v in (data or {}).items()})], "src string, dst string, kind string, weight double, data map<string,string>")
    row = row.select([c for c in row.columns if c in edges.columns])
    fresh = row.join(edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
    return replace(catalog, edges=edges.unionByName(fresh.select(edges.columns)))


def delete_edges(catalog: Catalog, rule: Column) -> Catalog:
    return replace(catalog, edges=catalog.edges.filter(~F.coalesce(rule, F.lit(False))))


def retract(nodes: DataFrame, ident: str, reason: str | None, now_ms: int) -> DataFrame:
    if not exists(nodes, ident):
        raise NodeNotFound(ident)
    return update_where(nodes, _is(ident), {"__retracted__": 1, "__retracted_at__": now_ms, "__retract_reason__": reason}, now_ms)


def assert_node(nodes: DataFrame, ident: str, kind: str, fields: dict[str, Any], now_ms: int, confidence: float | None = None, source: str | None = None) -> DataFrame:
    """Upsert with the belief's columns; an earlier retraction ends."""
    more = {"__retracted__": 0, "__confidence__": confidence, "__source__": source}
    return upsert(nodes, ident, kind, {**fields, **{k: v for k, v in more.items() if v is not None}}, now_ms)
