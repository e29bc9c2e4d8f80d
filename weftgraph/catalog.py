"""The tables a graph consists of, and the graph over the driver's star schema."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the engine itself; hidden from results, usable in predicates.
RESERVED = {
    "__created_at__": "long",
    "__updated_at__": "long",
    "__event_at__": "long",
    "__expires_at__": "long",
    "__retracted__": "long",
    "__retracted_at__": "long",
    "__retract_reason__": "string",
    "__confidence__": "double",
    "__source__": "string",
    "__context__": "string",
    "__namespace__": "string",
    "__recall_count__": "long",
    "__last_recalled_at__": "long",
    "__blob_state__": "string",
}
EDGE_SCHEMA = "src string, dst string, kind string, weight double, data map<string,string>"


@dataclass(frozen=True)
class Session:
    """What a statement is evaluated under; ``now_ms`` is injected so that plans are deterministic."""

    now_ms: int = 1_735_689_600_000
    context: str | None = None
    namespace: str | None = None


@dataclass(frozen=True)
class Catalog:
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    documents: DataFrame | None = None
    session: Session = field(default_factory=Session)

    def with_tables(self, **tables: DataFrame) -> Catalog:
        return replace(self, **tables)


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def alive(nodes: DataFrame, session: Session) -> Column:
    """The predicate every operator applies: not expired, not retracted, in the bound context and namespace."""
    rule = F.lit(True)
    if has(nodes, "__expires_at__"):
        at = F.col("__expires_at__")
        rule &= at.isNull() | (at <= 0) | (at >= session.now_ms)
    if has(nodes, "__retracted__"):
        rule &= F.coalesce(F.col("__retracted__"), F.lit(0)) != 1
    if session.context is not None:
        rule &= F.col("__context__").eqNullSafe(session.context) if has(nodes, "__context__") else F.lit(False)
    if has(nodes, "__namespace__"):
        rule &= F.col("__namespace__").eqNullSafe(session.namespace)
    elif session.namespace is not None:
        rule &= F.lit(False)
    return rule


def visible_nodes(catalog: Catalog) -> DataFrame:
    return catalog.nodes.filter(alive(catalog.nodes, catalog.session))


def visible_edges(catalog: Catalog, kind: str | None = None) -> DataFrame:
    """Edges, of one kind if given, between two visible nodes."""
    edges = catalog.edges if kind is None else catalog.edges.filter(F.col("kind") == kind)
    ids = visible_nodes(catalog).select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def public(df: DataFrame) -> DataFrame:
    """Without the reserved columns."""
    return df.select([c for c in df.columns if not (c.startswith("_") and c.endswith("_") and len(c) > 1)])


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def star_nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("region", "nation", "customer", "supplier", "part", "order")) -> DataFrame:
    """Nodes of the star schema; the id is the kind and the primary key."""
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "order": "o_orderkey"}
    parts = []
    for kind in kinds:
        table = spark.read.parquet(f"{sf_dir}/{'orders' if kind == 'order' else kind}.parquet")
        parts.append(table.select(_id(kind, keys[kind]).alias("id"), F.lit(kind).alias("kind"), "*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def star_edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("in_region", "in_nation", "placed_by", "contains", "supplied_by")) -> DataFrame:
    """Edges of the star schema, one for each (src, dst, kind)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    edge = lambda df, a, ka, b, kb, kind, w: df.select(_id(a, ka).alias("src"), _id(b, kb).alias("dst"), F.lit(kind).alias("kind"), w.cast("double").alias("weight"))
    one, parts = F.lit(1.0), []
    if "in_region" in kinds:
        parts.append(edge(read("nation"), "nation", "n_nationkey", "region", "n_regionkey", "in_region", one))
    if "in_nation" in kinds:
        parts.append(edge(read("customer"), "customer", "c_custkey", "nation", "c_nationkey", "in_nation", one))
        parts.append(edge(read("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation", one))
    if "placed_by" in kinds:
        parts.append(edge(read("orders"), "order", "o_orderkey", "customer", "o_custkey", "placed_by", one))
    if "contains" in kinds:
        parts.append(edge(read("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("w")), "order", "l_orderkey", "part", "l_partkey", "contains", F.col("w")))
    if "supplied_by" in kinds:
        parts.append(edge(read("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("w")), "part", "l_partkey", "supplier", "l_suppkey", "supplied_by", F.col("w")))
    return reduce(DataFrame.unionByName, parts)


def star(spark: SparkSession, sf_dir: str, session: Session | None = None) -> Catalog:
    return Catalog(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), session=session or Session())
