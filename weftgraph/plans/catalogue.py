"""Queries over the driver's tables, each with the SQL that gives the same rows.

The graph is the star schema: nodes are its rows, named by kind and key, and edges its foreign keys. Queries that can't be
said in SQL have no SQL here and are tested on small graphs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Session, star, star_edges, star_nodes, visible_edges
from ..config import Config
from ..functions import text as T
from ..functions.temporal import extract_dates
from ..operators import graph as G
from ..operators import maintenance as M
from ..operators import predicates as P
from ..operators import retrieval as R
from ..operators import writes as Wr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EDGES = """edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'in_region' AS kind, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation', 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation', 1.0 FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', 1.0 FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', sum(l_quantity) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', count(*)::DOUBLE FROM lineitem GROUP BY l_partkey, l_suppkey
)"""
#: A start that exists at every scale.
ORDER, ORDER2, NATION = "order:1", "order:2", "nation:3"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_nodes(spark, sf_dir, ("order",))


def _start(spark: SparkSession, sf_dir: str) -> str:
    """The first order, whatever key the generator gave it."""
    return "order:" + str(_table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0])


_FIRST = "(SELECT 'order:' || min(o_orderkey) FROM orders)"
_SECOND = "(SELECT 'order:' || min(o_orderkey) FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders))"


def _two(spark: SparkSession, sf_dir: str) -> list[str]:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(2).collect()
    return [f"order:{r.o_orderkey}" for r in rows]


# nodes and aggregates


@query(
    "agg_group_having_topk",
    """SELECT o_orderpriority, count(*) AS count_all, round(sum(o_totalprice), 2) AS sum_total FROM orders
       WHERE o_totalprice > 250000 GROUP BY o_orderpriority HAVING count(*) > 1 ORDER BY count_all DESC, o_orderpriority LIMIT 10""",
)
def agg_group_having_topk(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    found = orders.filter(P.compile_rule(orders, P.Cmp("o_totalprice", ">", 250000.0)))
    out = P.aggregate(found, [("COUNT", None, "count_all"), ("SUM", "o_totalprice", "sum_total")], ["o_orderpriority"])
    return out.filter("count_all > 1").withColumn("sum_total", F.round("sum_total", 2)).orderBy(F.desc("count_all"), "o_orderpriority").limit(10)


@query("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus")
def agg_count_distinct(spark, sf_dir):
    out = P.aggregate(
        _orders(spark, sf_dir),
        [("COUNT_DISTINCT", "o_custkey", "customers"), ("MIN", "o_totalprice", "low"), ("MAX", "o_totalprice", "high"), ("AVG", "o_totalprice", "mean")],
        ["o_orderstatus"],
    )
    return out.withColumn("mean", F.round("mean", 4))


@query("agg_global_empty", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS total, 0.0::DOUBLE AS low, CAST(NULL AS DOUBLE) AS mean")
def agg_global_empty(spark, sf_dir):
    none = _orders(spark, sf_dir).filter(F.col("o_totalprice") < -1)
    return P.aggregate(none, [("COUNT", None, "n"), ("SUM", "o_totalprice", "total"), ("MIN", "o_totalprice", "low"), ("AVG", "o_totalprice", "mean")])


@query("agg_group_by_kind", "SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def agg_group_by_kind(spark, sf_dir):
    return P.aggregate(star_nodes(spark, sf_dir, ("customer", "supplier", "part")), [("COUNT", None, "n")], ["kind"])


@query("node_lookup", "SELECT 'customer:' || c_custkey AS id, 'customer' AS kind, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def node_lookup(spark, sf_dir):
    return star_nodes(spark, sf_dir, ("customer",)).filter(F.col("id") == "customer:7").select("id", "kind", "c_name", "c_acctbal")


@query(
    "nodes_filter_order",
    "SELECT 'order:' || o_orderkey AS id, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus = 'O' OR o_orderpriority != '1-URGENT') ORDER BY o_totalprice DESC, id LIMIT 20 OFFSET 5",
)
def nodes_filter_order(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    rule = P.And((P.Cmp("o_totalprice", ">", 100000.0), P.Or((P.Cmp("o_orderstatus", "=", "O"), P.Cmp("o_orderpriority", "!=", "1-URGENT")))))
    found = orders.filter(P.compile_rule(orders, rule)).orderBy(*P.order_by(orders, "o_totalprice", True)).offset(5).limit(20)
    return found.select("id", "o_totalprice", "o_orderstatus")


@query(
    "nodes_like_contains_in_not",
    """SELECT 'part:' || p_partkey AS id, p_name, p_size FROM part
       WHERE p_name LIKE '%e_%' AND contains(p_type, 'A') AND p_size IN (1, 5, 10, 15, 20, 25, 30) AND NOT (p_brand = 'Brand#11')""",
)
def nodes_like_contains_in_not(spark, sf_dir):
    part = star_nodes(spark, sf_dir, ("part",))
    rule = P.And((P.Like("p_name", "%e_%"), P.Contains("p_type", "A"), P.In("p_size", (1, 5, 10, 15, 20, 25, 30)), P.Not(P.Cmp("p_brand", "=", "Brand#11"))))
    return part.filter(P.compile_rule(part, rule)).select("id", "p_name", "p_size")


@query("nodes_null_presence", "SELECT count(*) AS n FROM supplier WHERE s_acctbal IS NOT NULL AND NOT (s_acctbal < 0)")
def nodes_null_presence(spark, sf_dir):
    nodes = star_nodes(spark, sf_dir, ("customer", "supplier"))
    rule = P.And((P.Cmp("s_acctbal", "!=", None), P.Not(P.Cmp("s_acctbal", "<", 0.0))))
    return nodes.filter(P.compile_rule(nodes, rule)).agg(F.count(F.lit(1)).alias("n"))


@query("count_nodes", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS n")
def count_nodes(spark, sf_dir):
    return star_nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query("count_edges", f"WITH {EDGES} SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def count_edges(spark, sf_dir):
    return star_edges(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# edges and patterns


@query("edges_from_to", f"WITH {EDGES} SELECT src, dst, kind, weight FROM edges WHERE src = {_FIRST} OR dst = 'nation:3'")
def edges_from_to(spark, sf_dir):
    edges = visible_edges(star(spark, sf_dir))
    first = _start(spark, sf_dir)
    return edges.filter((F.col("src") == first) | (F.col("dst") == NATION)).select("src", "dst", "kind", "weight")


@query("degree_filter", f"WITH {EDGES} SELECT dst AS id, count(*) AS degree FROM edges WHERE kind = 'placed_by' GROUP BY dst HAVING count(*) >= 12")
def degree_filter(spark, sf_dir):
    return G.degrees(star_edges(spark, sf_dir, ("placed_by",)), True, "placed_by").filter("degree >= 12")


@query("out_degree", f"WITH {EDGES} SELECT src AS id, count(DISTINCT dst) AS degree FROM edges GROUP BY src HAVING count(DISTINCT dst) > 7")
def out_degree(spark, sf_dir):
    return G.degrees(star_edges(spark, sf_dir), False).filter("degree > 7")


@query("common_neighbors", f"WITH {EDGES} SELECT dst AS id FROM edges WHERE src = 'customer:1' INTERSECT SELECT dst FROM edges WHERE src = (SELECT min('customer:' || c_custkey) FROM customer WHERE c_custkey > 1 AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 1))")
def common_neighbors(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    nation = customer.filter("c_custkey = 1").first().c_nationkey
    other = customer.filter(f"c_custkey > 1 and c_nationkey = {nation}").agg(F.min(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")))).first()[0]
    return G.common_neighbors(star_edges(spark, sf_dir, ("in_nation",)), "customer:1", other or "customer:1")


@query(
    "match_two_hop",
    f"""WITH {EDGES} SELECT a.src AS o, a.dst AS c, b.dst AS n FROM edges a JOIN edges b ON a.dst = b.src
        JOIN orders ON a.src = 'order:' || o_orderkey WHERE a.kind = 'placed_by' AND b.kind = 'in_nation' AND o_totalprice > 450000""",
)
def match_two_hop(spark, sf_dir):
    nodes = star_nodes(spark, sf_dir, ("order", "customer", "nation"))
    steps = [("o", (F.col("kind") == "order") & (F.col("o_totalprice") > 450000)), ("c", None), ("n", None)]
    return G.match_chain(nodes, star_edges(spark, sf_dir, ("placed_by", "in_nation")), steps, ["placed_by", "in_nation"])


# traversal

_WALK = f"""WITH RECURSIVE {EDGES}, walk(id, depth) AS (
  SELECT {{start}}, 0 UNION SELECT {{to}}, depth + 1 FROM walk JOIN edges ON {{on}} = id WHERE depth < {{n}}
), reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


@query("traverse_depth", _WALK.format(start=_FIRST, to="dst", on="src", n=3) + " SELECT id, depth FROM reached")
def traverse_depth(spark, sf_dir):
    found = G.traverse(star_edges(spark, sf_dir), star_nodes(spark, sf_dir), _start(spark, sf_dir), 3)
    return found.select("id", F.col("_depth").alias("depth"))


@query("subgraph", _WALK.format(start=_FIRST, to="dst", on="src", n=2) + " SELECT src, dst, kind, weight FROM edges WHERE src IN (SELECT id FROM reached) AND dst IN (SELECT id FROM reached)")
def subgraph(spark, sf_dir):
    edges = star_edges(spark, sf_dir)
    return G.among(edges, G.bfs(edges, _start(spark, sf_dir), 2)).select("src", "dst", "kind", "weight")


@query("ancestors", _WALK.format(start="'nation:3'", to="src", on="dst", n=1) + " SELECT id, depth, id = 'nation:3' AS query_anchor FROM reached")
def ancestors(spark, sf_dir):
    found = G.bfs(G.reversed_edges(star_edges(spark, sf_dir)), NATION, 1)
    return found.select("id", "depth", (F.col("id") == NATION).alias("query_anchor"))


@query("descendants", _WALK.format(start="'supplier:1'", to="dst", on="src", n=4) + " SELECT id, depth FROM reached")
def descendants(spark, sf_dir):
    return G.bfs(star_edges(spark, sf_dir), "supplier:1", 4)


@query("what_if", _WALK.format(start=_SECOND, to="dst", on="src", n=50) + " SELECT id FROM reached")
def what_if(spark, sf_dir):
    return G.bfs(star_edges(spark, sf_dir), _two(spark, sf_dir)[1]).select("id")


_PATHS = f"""WITH RECURSIVE {EDGES}, hops AS (SELECT DISTINCT src, dst FROM edges), walk(id, path, n) AS (
  SELECT {_FIRST}, [{_FIRST}], 0
  UNION ALL SELECT dst, list_append(path, dst), n + 1 FROM walk JOIN hops ON src = id WHERE n < 5 AND NOT list_contains(path, dst) AND id NOT LIKE 'region:%'
), goal AS (SELECT min(dst) AS id FROM edges WHERE kind = 'in_region'), hit AS (SELECT path, n FROM walk WHERE id = (SELECT id FROM goal))"""


def _goal(edges: DataFrame) -> str:
    return edges.filter("kind = 'in_region'").agg(F.min("dst")).first()[0]


@query("path_shortest", _PATHS + " SELECT array_to_string(path, '>') AS path, n AS hops FROM hit ORDER BY n, path LIMIT 1")
def path_shortest(spark, sf_dir):
    edges = star_edges(spark, sf_dir)
    return G.shortest_path(edges, _start(spark, sf_dir), _goal(edges), 5).select(F.array_join("path", ">").alias("path"), "hops")


@query("distance", _PATHS + " SELECT coalesce(min(n), -1) AS distance FROM hit")
def distance(spark, sf_dir):
    edges = star_edges(spark, sf_dir)
    return G.distance(edges, _start(spark, sf_dir), _goal(edges), 5)


@query("paths_all", _PATHS + " SELECT array_to_string(path, '>') AS path, n AS hops FROM hit ORDER BY n, path LIMIT 100")
def paths_all(spark, sf_dir):
    edges = star_edges(spark, sf_dir)
    return G.all_paths(edges, _start(spark, sf_dir), _goal(edges), 5).select(F.array_join("path", ">").alias("path"), "hops")


@query(
    "weighted_distance",
    f"""WITH RECURSIVE {EDGES}, w AS (SELECT src, dst, sum(weight) AS w FROM edges GROUP BY src, dst), walk(id, cost) AS (
          SELECT {_FIRST}, 0.0::DOUBLE UNION SELECT dst, cost + w FROM walk JOIN w ON src = id WHERE cost + w <= 60
        ) SELECT id, min(cost) AS cost FROM walk GROUP BY id""",
)
def weighted_distance(spark, sf_dir):
    return G.weighted(star_edges(spark, sf_dir), _start(spark, sf_dir), 60.0).select("id", "cost")


@query(
    "recall_activation",
    f"""WITH {EDGES}, both_ways AS (SELECT src, dst, weight AS w FROM edges UNION ALL SELECT dst, src, weight FROM edges),
        a0 AS (SELECT 'customer:1' AS id, 1.0::DOUBLE AS score),
        a1 AS (SELECT id, sum(score) AS score FROM (SELECT * FROM a0 UNION ALL SELECT dst, 0.5 * w * score FROM both_ways JOIN a0 ON src = id) GROUP BY id),
        a2 AS (SELECT id, sum(score) AS score FROM (SELECT * FROM a1 UNION ALL SELECT dst, 0.5 * w * score FROM both_ways JOIN a1 ON src = id) GROUP BY id)
        SELECT id, round(score, 6) AS score FROM a2 WHERE id != 'customer:1' AND score > 0""",
)
def recall_activation(spark, sf_dir):
    return G.recall(star_edges(spark, sf_dir), "customer:1", 2, 0.5).select("id", F.round("score", 6).alias("score"))


@query(
    "propagate",
    f"""WITH {EDGES}, s AS (SELECT {_FIRST} AS id),
        h1 AS (SELECT dst AS id, min_by(2.0 * weight, src || kind) AS value FROM edges JOIN s ON src = id GROUP BY dst),
        h2 AS (SELECT dst AS id, min_by(value * weight, src || kind) AS value FROM edges JOIN h1 ON src = id WHERE dst NOT IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM s) GROUP BY dst)
        SELECT id, 0 AS depth, 2.0::DOUBLE AS value FROM s UNION ALL SELECT id, 1, value FROM h1 UNION ALL SELECT id, 2, value FROM h2""",
)
def propagate(spark, sf_dir):
    return G.propagate(star_edges(spark, sf_dir), _start(spark, sf_dir), 2.0, 2)


# retrieval


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", "embedding", "label")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("similar_topk", f"SELECT a.vec_id, round({_COS}, 4) AS similarity_score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b WHERE a.label != 3 ORDER BY similarity_score DESC, CAST(a.vec_id AS VARCHAR) LIMIT 10")
def similar_topk(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    target = vectors.filter("vec_id = 0").first().embedding
    return R.similar_to(vectors, target, 10, F.col("label") != 3).select("vec_id", F.col("_similarity_score").alias("similarity_score"))


@query("similar_predicate", f"SELECT a.vec_id FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) b WHERE {_COS} >= 0.3")
def similar_predicate(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    target = F.array(*[F.lit(float(x)) for x in vectors.filter("vec_id = 1").first().embedding])
    scored = vectors.withColumn("__similarity", R.cosine(F.col("embedding"), target))
    return scored.filter(P.compile_rule(scored, P.Similar("", ">=", 0.3))).select("vec_id")


@query(
    "duplicates",
    f"""WITH p AS (SELECT CAST(a.vec_id AS VARCHAR) AS a, CAST(b.vec_id AS VARCHAR) AS b, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id),
        n AS (SELECT a, arg_max(b, {{'s': s, 'b': b}}) AS b, max(s) AS s FROM p WHERE s >= 0.95 GROUP BY a)
        SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, round(s, 4) AS similarity FROM n""",
)
def duplicates(spark, sf_dir):
    return R.duplicates(_vectors(spark, sf_dir), 0.95)


@query(
    "connect_topk",
    f"""SELECT src, dst, weight FROM (SELECT CAST(a.vec_id AS VARCHAR) AS src, CAST(b.vec_id AS VARCHAR) AS dst, round({_COS}, 4) AS weight,
          row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, CAST(b.vec_id AS VARCHAR)) AS place
        FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id WHERE {_COS} >= 0.85) WHERE place <= 10""",
)
def connect_topk(spark, sf_dir):
    return R.connect(_vectors(spark, sf_dir), 0.85, 10)


_BM25 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents),
  c AS (SELECT doc_id, len(words)::DOUBLE AS dl, len(list_filter(words, lambda x: x = 'the'))::DOUBLE AS t0, len(list_filter(words, lambda x: x = 'und'))::DOUBLE AS t1, len(list_filter(words, lambda x: x = 'threea'))::DOUBLE AS t2 FROM d),
  s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS l, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1, sum((t2 > 0)::INT) AS d2 FROM c),
  b AS (SELECT doc_id AS id, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / l))
     + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / l))
     + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / l)) AS bm25 FROM c, s)"""


@query("lexical_bm25", _BM25 + " SELECT id, round(-bm25, 6) AS score FROM b WHERE bm25 > 0")
def lexical_bm25(spark, sf_dir):
    return R.bm25(_table(spark, sf_dir, "documents"), "the OR und threea").select("id", F.round("_bm25_score", 6).alias("score"))


def _candidates(spark, sf_dir) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    target = F.array(*[F.lit(float(x)) for x in vectors.filter("vec_id = 0").first().embedding])
    vec = vectors.select(F.col("vec_id").alias("id"), R.cosine(F.col("embedding"), target).alias("vec"))
    lex = R.bm25(_table(spark, sf_dir, "documents"), "the und threea").select("id", (-F.col("_bm25_score")).alias("bm25"))
    return vec.join(lex, "id", "full_outer")


@query(
    "remember_fusion",
    _BM25 + f""", v AS (SELECT a.vec_id AS id, {_COS} AS vec FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b),
    j AS (SELECT coalesce(v.id, b.id) AS id, greatest(coalesce(vec, 0), 0) AS vec, coalesce(bm25, 0) / (SELECT max(bm25) FROM b) AS lex FROM v FULL JOIN (SELECT * FROM b WHERE bm25 > 0) b ON v.id = b.id),
    f AS (SELECT id, round(0.52 * vec + 0.25 * lex + CASE WHEN vec > 0 AND lex > 0 THEN 0.1 * least(vec, lex) ELSE 0 END, 4) AS score FROM j)
    SELECT id, score FROM f ORDER BY score DESC, id LIMIT 20""",
)
def remember_fusion(spark, sf_dir):
    found = _candidates(spark, sf_dir).withColumns({"event_ms": F.lit(None).cast("long"), "graph": F.lit(0.0), "recall_count": F.lit(0)})
    fused = R.remember(found, Config().remember_weights, Config().recency_half_life_days)
    return fused.select("id", F.col("_remember_score").alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(
    "rrf_fusion",
    """WITH c AS (SELECT s_suppkey AS id, s_acctbal AS a, (s_nationkey)::DOUBLE AS b FROM supplier),
       r AS (SELECT id, CASE WHEN a > 0 THEN rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 ELSE count(*) OVER () END AS ra,
                    CASE WHEN b > 0 THEN rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 ELSE count(*) OVER () END AS rb FROM c)
       SELECT id, round(1 / (60 + ra) + 1 / (60 + rb), 9) AS rrf FROM r""",
)
def rrf_fusion(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return R.rrf(rows, ["a", "b"]).select("id", F.round("rrf", 9).alias("rrf"))


# maintenance and writes

NOW = 1_706_659_200_000  # 2024-01-31
_EVENTS = "SELECT 'event:' || event_id AS id, 'event' AS kind, event_type, value, user_id, epoch_us(ts) // 1000 AS t FROM events"


def _events(spark, sf_dir) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"), F.lit("event").alias("kind"), "event_type", "value", "user_id",
        ms.alias("__updated_at__"), (ms + 10 * M.DAY_MS).alias("__expires_at__"), F.lit("warm").alias("__blob_state__"),
    )


@query("expire", f"SELECT id FROM ({_EVENTS}) WHERE t + 864000000 < {NOW}")
def expire(spark, sf_dir):
    return M.expired(_events(spark, sf_dir), NOW, "event")


@query("evict_order", f"SELECT id, t AS updated_at FROM ({_EVENTS}) ORDER BY t, id LIMIT 50")
def evict_order(spark, sf_dir):
    return M.eviction_order(_events(spark, sf_dir), 50).withColumnRenamed("__updated_at__", "updated_at")


@query("retain", f"SELECT blob_state, count(*) AS n FROM (SELECT CASE WHEN {NOW} + 7776000000 - t > 9504000000 THEN 'archived' ELSE 'warm' END AS blob_state FROM ({_EVENTS})) GROUP BY blob_state")
def retain(spark, sf_dir):
    kept = M.retained(_events(spark, sf_dir), NOW + 90 * M.DAY_MS, archive_days=110)
    return kept.groupBy(F.col("__blob_state__").alias("blob_state")).agg(F.count(F.lit(1)).alias("n"))


@query("contradictions", 'SELECT c_nationkey AS "group", count(DISTINCT c_mktsegment) AS n_values, count(*) AS n_nodes, min(c_mktsegment) AS low, max(c_mktsegment) AS high FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1')
def contradictions(spark, sf_dir):
    return M.contradictions(star_nodes(spark, sf_dir, ("customer",)), "c_mktsegment", "c_nationkey")


@query("sys_stats", f"WITH {EDGES} SELECT 'edges' AS what, kind, count(*) AS n FROM edges GROUP BY kind UNION ALL SELECT 'nodes', 'nation', count(*) FROM nation UNION ALL SELECT 'nodes', 'region', count(*) FROM region")
def sys_stats(spark, sf_dir):
    return M.stats(star_nodes(spark, sf_dir, ("nation", "region")), star_edges(spark, sf_dir))


@query("sys_health", f"WITH {EDGES} SELECT count(*) AS n_edges, sum((dst NOT LIKE 'customer:%' AND dst NOT LIKE 'nation:%')::INT)::BIGINT AS n_stale FROM edges WHERE kind IN ('in_nation', 'in_region', 'placed_by')")
def sys_health(spark, sf_dir):
    nodes = star_nodes(spark, sf_dir, ("nation", "customer", "supplier", "order"))
    return M.health(nodes, star_edges(spark, sf_dir, ("in_nation", "in_region", "placed_by")))


def _small(spark, sf_dir) -> Catalog:
    return Catalog(star_nodes(spark, sf_dir, ("supplier", "nation")), star_edges(spark, sf_dir, ("in_nation", "in_region")), session=Session(now_ms=NOW))


@query("update_nodes", f"SELECT 'supplier:' || s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'debtor' END AS standing, CASE WHEN s_acctbal < 0 THEN {NOW} END AS updated_at FROM supplier")
def update_nodes(spark, sf_dir):
    out = Wr.update_where(star_nodes(spark, sf_dir, ("supplier",)), F.col("s_acctbal") < 0, {"standing": "debtor"}, NOW)
    return out.select("id", "standing", F.col("__updated_at__").alias("updated_at"))


@query("upsert", "SELECT 'supplier:' || s_suppkey AS id, s_name, CASE WHEN s_suppkey = 1 THEN 5.5 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT 'supplier:new', 'New', NULL")
def upsert(spark, sf_dir):
    nodes = Wr.upsert(star_nodes(spark, sf_dir, ("supplier",)), "supplier:1", "supplier", {"s_acctbal": 5.5}, NOW)
    return Wr.upsert(nodes, "supplier:new", "supplier", {"s_name": "New"}, NOW).select("id", "s_name", "s_acctbal")


@query("upsert_bulk", "SELECT 'customer:' || c_custkey AS id, c_acctbal + coalesce(v, 0) AS balance FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS v FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def upsert_bulk(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("long").alias("n_orders"))
    rows = orders.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id"), "n_orders")
    out = Wr.upsert_rows(star_nodes(spark, sf_dir, ("customer",)), rows)
    return out.select("id", (F.col("c_acctbal") + F.coalesce("n_orders", F.lit(0))).alias("balance"))


@query("increment", "SELECT 'supplier:' || s_suppkey AS id, s_nationkey + CASE WHEN s_suppkey = 2 THEN 0.5 ELSE 0 END::DOUBLE AS s_nationkey FROM supplier")
def increment(spark, sf_dir):
    return Wr.increment(star_nodes(spark, sf_dir, ("supplier",)), "supplier:2", "s_nationkey", 0.5).select("id", F.col("s_nationkey").cast("double").alias("s_nationkey"))


@query("merge_node", f"WITH {EDGES} SELECT DISTINCT CASE WHEN src = 'supplier:1' THEN 'supplier:2' ELSE src END AS src, dst, kind FROM edges WHERE kind IN ('in_nation', 'in_region')")
def merge_node(spark, sf_dir):
    return Wr.merge_node(_small(spark, sf_dir), "supplier:1", "supplier:2", NOW).edges.select("src", "dst", "kind")


@query("delete_cascade", f"WITH {EDGES} SELECT src, dst, kind FROM edges WHERE kind IN ('in_nation', 'in_region') AND src NOT IN ('nation:3') AND dst NOT IN ('nation:3')")
def delete_cascade(spark, sf_dir):
    catalog = _small(spark, sf_dir)
    return Wr.delete_nodes(catalog, catalog.nodes.filter(F.col("id") == NATION)).edges.select("src", "dst", "kind")


@query("visibility", "SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_suppkey != 3")
def visibility(spark, sf_dir):
    from ..catalog import visible_nodes

    nodes = Wr.retract(star_nodes(spark, sf_dir, ("supplier",)), "supplier:3", "test", NOW)
    return visible_nodes(Catalog(nodes, star_edges(spark, sf_dir, ("in_nation",)), session=Session(now_ms=NOW))).select("id")


# functions


@query("chunk_fixed", "SELECT doc_id, generate_series // 1950 AS chunk, substr(text, generate_series + 1, 2000) AS body FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1950)) AS generate_series FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.chunk_fixed(F.col("text"))).alias("chunk", "body")).withColumn("chunk", F.col("chunk").cast("long"))


@query(
    "slug",
    """SELECT doc_id, CASE WHEN length(s) > 40 THEN substr(s, 1, 33) || '_' || substr(sha256(t), 1, 6) ELSE s END AS slug
       FROM (SELECT doc_id, t, regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM (SELECT doc_id, substr(text, 1, 1 + (doc_id % 80)::INT) AS t FROM documents))""",
)
def slug(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.slug(F.expr("substring(text, 1, 1 + cast(doc_id % 80 as int))")).alias("slug"))


@query(
    "slug_whole",
    """SELECT doc_id, CASE WHEN length(s) > 40 THEN substr(s, 1, 33) || '_' || substr(sha256(text), 1, 6) ELSE s END AS slug
       FROM (SELECT doc_id, text, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)""",
)
def slug_whole(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("auto_id", "SELECT c_custkey, substr(sha256('kind=customer|name=' || c_name || '|nation=' || c_nationkey), 1, 16) AS id FROM customer")
def auto_id(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", T.auto_id("customer", name=F.col("c_name"), nation=F.col("c_nationkey")).alias("id"))


@query("summary", r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substr(text, 1, 200), '\s+\S*$', '') || '...' END AS summary FROM documents")
def summary(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("sentence_split")
def sentence_split(spark, sf_dir):
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(T.split_sentences)

    docs = _table(spark, sf_dir, "documents").select("doc_id", split("text").alias("s"))
    return docs.select("doc_id", F.posexplode("s").alias("place", "sentence"))


@query("date_extract")
def date_extract(spark, sf_dir):
    @F.pandas_udf("array<bigint>")
    def dates(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: extract_dates(t, NOW))

    rows = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("seen on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" and 2 days ago")).alias("text"))
    return rows.select("event_id", F.posexplode(dates("text")).alias("place", "at"))


# statements without a query above


_ALL_NODES = """nodes AS (
  SELECT 'region' AS kind, NULL AS segment, NULL AS nation, NULL AS balance, NULL AS part FROM region
  UNION ALL SELECT 'nation', NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'customer', c_mktsegment, c_nationkey, c_acctbal, NULL FROM customer
  UNION ALL SELECT 'supplier', NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'part', NULL, NULL, NULL, p_name FROM part
  UNION ALL SELECT 'order', NULL, NULL, NULL, NULL FROM orders
)"""


@query(
    "agg_many_keys_nulls",
    f"""WITH {_ALL_NODES} SELECT kind, segment AS c_mktsegment, count(*) AS count_all, count(balance) AS balances, count(DISTINCT nation) AS nations,
        round(avg(balance), 4) AS mean, round(sum(balance), 2) AS total, min(part) AS first_part FROM nodes GROUP BY kind, segment""",
)
def agg_many_keys_nulls(spark, sf_dir):
    """Groups by two fields of which one is null for most kinds, over all nodes."""
    aggs = [("COUNT", None, "count_all"), ("COUNT", "c_acctbal", "balances"), ("COUNT_DISTINCT", "c_nationkey", "nations")]
    aggs += [("AVG", "c_acctbal", "mean"), ("SUM", "c_acctbal", "total"), ("MIN", "p_name", "first_part")]
    out = P.aggregate(star_nodes(spark, sf_dir), aggs, ["kind", "c_mktsegment"])
    return out.withColumns({"mean": F.round("mean", 4), "total": F.round("total", 2)})


@query(
    "nodes_string_order",
    "SELECT 'customer:' || c_custkey AS id, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, 'customer:' || c_custkey LIMIT 20 OFFSET 5",
)
def nodes_string_order(spark, sf_dir):
    customers = star_nodes(spark, sf_dir, ("customer",))
    return customers.orderBy(*P.order_by(customers, "c_mktsegment", True)).offset(5).limit(20).select("id", "c_mktsegment")


@query(
    "ancestors_depth",
    f"""WITH RECURSIVE {EDGES}, hops AS (SELECT DISTINCT src, dst FROM edges), walk(id, n) AS (
          SELECT 'region:1', 0 UNION SELECT src, n + 1 FROM walk JOIN hops ON dst = id WHERE n < 3
        ) SELECT id, min(n) AS depth FROM walk GROUP BY id""",
)
def ancestors_depth(spark, sf_dir):
    """All nodes from which a region is reached in three hops."""
    return G.bfs(G.reversed_edges(star_edges(spark, sf_dir)), "region:1", 3)


@query(
    "edges_degree_both",
    f"""WITH {EDGES}, ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges)
        SELECT id, sum(o)::BIGINT AS out_edges, sum(i)::BIGINT AS in_edges FROM ends GROUP BY id HAVING sum(o) > 0 AND sum(i) > 0""",
)
def edges_degree_both(spark, sf_dir):
    edges = star_edges(spark, sf_dir)
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    out = P.aggregate(ends, [("SUM", "o", "out_edges"), ("SUM", "i", "in_edges")], ["id"]).filter("out_edges > 0 and in_edges > 0")
    return out.select("id", F.col("out_edges").cast("long").alias("out_edges"), F.col("in_edges").cast("long").alias("in_edges"))
