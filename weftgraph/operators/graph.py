"""Graph operators as iterative joins over an edge table (src, dst, kind, weight).

Each round joins the frontier with the edges and writes the new state to the shared folder, so a
plan never grows with the depth and a lost executor repeats one round at most. Only "is the
frontier empty" comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CostThresholdExceeded
from ..storage import materialise


def of_kind(edges: DataFrame, kind: str | None) -> DataFrame:
    return edges if kind is None else edges.filter(F.col("kind") == kind)


def reversed_edges(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.select([F.col(swap.get(c, c)).alias(c) for c in edges.columns])


def _seed(spark: SparkSession, start: str, **more) -> DataFrame:
    return spark.createDataFrame([(start, *[v for v, _ in more.values()])], "id string" + "".join(f", {k} {t}" for k, (_, t) in more.items()))


def _pairs(edges: DataFrame, depth: int | None) -> DataFrame:
    """Distinct ends of ``edges``, written once where more than one hop reads them."""
    pairs = edges.select("src", "dst").distinct()
    return pairs if depth is not None and depth < 2 else materialise(pairs, "pairs")


def bfs(edges: DataFrame, start: str, depth: int | None = None) -> DataFrame:
    """``id, depth`` of the nodes reached from ``start`` in at most ``depth`` hops, the start included."""
    spark = edges.sparkSession
    pairs = _pairs(edges, depth)
    seen = materialise(_seed(spark, start, depth=(0, "int")), "seen")
    frontier, hop = seen, 0
    while depth is None or hop < depth:
        hop += 1
        step = pairs.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialise(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(hop)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def traverse(edges: DataFrame, nodes: DataFrame, start: str, depth: int, kind: str | None = None) -> DataFrame:
    """Visible ``nodes`` with ``_depth``; invisible nodes are walked through. An unknown start gives nothing."""
    found = bfs(of_kind(edges, kind), start, depth)
    return nodes.join(found.withColumnRenamed("depth", "_depth"), "id")


def among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def shortest_path(edges: DataFrame, a: str, b: str, max_depth: int | None = None) -> DataFrame:
    """``path, hops`` of the shortest path, the lexicographically smallest of several; no row if there is none."""
    spark = edges.sparkSession
    pairs = _pairs(edges, max_depth)
    frontier = materialise(spark.createDataFrame([(a, [a])], "id string, path array<string>"), "path")
    seen, hop = frontier.select("id"), 0
    while True:
        hit = frontier.filter(F.col("id") == b)
        if hit.limit(1).count() or (max_depth is not None and hop >= max_depth):
            return hit.select("path", (F.size("path") - 1).alias("hops"))
        hop += 1
        step = pairs.join(frontier.withColumnRenamed("id", "src"), "src").join(seen.withColumnRenamed("id", "dst"), "dst", "left_anti")
        step = step.groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier = materialise(step, "path")
        if not frontier.limit(1).count():
            return frontier.select("path", (F.size("path") - 1).alias("hops"))
        seen = seen.unionByName(frontier.select("id"))


def distance(edges: DataFrame, a: str, b: str, max_depth: int | None = None) -> DataFrame:
    """One row ``distance``: hops, or -1."""
    found = shortest_path(edges, a, b, max_depth).agg(F.min("hops").alias("hops"))
    return found.select(F.coalesce("hops", F.lit(-1)).alias("distance"))


def all_paths(edges: DataFrame, a: str, b: str, max_depth: int, cap: int = 100) -> DataFrame:
    """``path, hops`` of the simple paths of at most ``max_depth`` hops; the ``cap`` first by length and then by name."""
    spark = edges.sparkSession
    pairs = _pairs(edges, max_depth)
    frontier = spark.createDataFrame([(a, [a])], "id string, path array<string>")
    found = [frontier.filter(F.col("id") == b)]
    for _ in range(max_depth):
        open_ = frontier.filter(F.col("id") != b).withColumnRenamed("id", "src")
        step = pairs.join(open_, "src").filter(~F.array_contains("path", F.col("dst")))
        frontier = materialise(step.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")), "paths")
        found.append(frontier.filter(F.col("id") == b))
        if not frontier.limit(1).count():
            break
    every = reduce(DataFrame.unionByName, found).select("path", (F.size("path") - 1).alias("hops"))
    return every.orderBy("hops", "path").limit(cap)


def weighted(edges: DataFrame, a: str, max_cost: float | None = None) -> DataFrame:
    """``id, cost, path`` of the cheapest paths from ``a`` (Bellman-Ford rounds until nothing improves).

    Weights of parallel edges are summed, a missing weight is 1.0, ``max_cost`` is a ceiling of the cost.
    """
    spark = edges.sparkSession
    summed = materialise(edges.groupBy("src", "dst").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w")), "weights")
    if summed.filter("w < 0").limit(1).count():
        raise ValueError("cheapest paths need weights of 0 or more")
    best = materialise(spark.createDataFrame([(a, 0.0, [a])], "id string, cost double, path array<string>"), "best")
    frontier = best
    while True:
        step = summed.join(frontier.withColumnRenamed("id", "src"), "src")
        step = step.select(F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        if max_cost is not None:
            step = step.filter(F.col("cost") <= max_cost)
        step = step.groupBy("id").agg(F.min(F.struct("cost", "path")).alias("top")).select("id", "top.cost", "top.path")
        held = best.select("id", F.col("cost").alias("old"))
        frontier = materialise(step.join(held, "id", "left").filter(F.col("old").isNull() | (F.col("cost") < F.col("old"))).drop("old"), "frontier")
        if not frontier.limit(1).count():
            return best
        best = materialise(best.join(frontier.select("id"), "id", "left_anti").unionByName(frontier), "best")


def common_neighbors(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Ids that both nodes point to."""
    out = lambda v: edges.filter(F.col("src") == v).select(F.col("dst").alias("id"))
    return out(a).intersect(out(b))


def degrees(edges: DataFrame, incoming: bool, kind: str | None = None) -> DataFrame:
    """``id, degree``: in-degree sums the kinds if none is given, out-degree counts distinct targets."""
    edges = of_kind(edges, kind)
    if incoming:
        return edges.select("src", "dst", "kind").distinct().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("degree"))


def match_chain(nodes: DataFrame, edges: DataFrame, steps: list[tuple[str, object]], kinds: list[str | None]) -> DataFrame:
    """Bindings of a directed chain: one column a step (name, predicate or None). Nodes may repeat.

    The planner joins from whichever end is the more selective; predicates reach the scans.
    """
    def ids(i: int) -> DataFrame:
        name, rule = steps[i]
        found = nodes if rule is None else nodes.filter(rule)
        return found.select(F.col("id").alias(name))

    out = ids(0)
    for i, kind in enumerate(kinds):
        here, there = steps[i][0], steps[i + 1][0]
        hop = of_kind(edges, kind).select(F.col("src").alias(here), F.col("dst").alias(there))
        out = out.join(hop, here).join(ids(i + 1), there)
    return out.select([name for name, _ in steps])


def recall(edges: DataFrame, start: str, depth: int, decay: float) -> DataFrame:
    """``id, score`` by spreading activation over the edges in both directions.

    Reciprocal edges and self-loops count twice; the cue itself is left out.
    """
    w = F.coalesce("weight", F.lit(1.0)).alias("w")
    both = edges.select("src", "dst", w).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w))
    both = materialise(both.groupBy("src", "dst").agg(F.sum("w").alias("w")), "spread")
    active = _seed(edges.sparkSession, start, score=(1.0, "double"))
    for _ in range(depth):
        sent = both.join(active.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.lit(decay) * F.col("w") * F.col("score")).alias("score"))
        active = materialise(active.unionByName(sent).groupBy("id").agg(F.sum("score").alias("score")), "active")
    return active.filter((F.col("id") != start) & (F.col("score") > 0))


def propagate(edges: DataFrame, start: str, value: float, depth: int) -> DataFrame:
    """``id, depth, value``: the value times the weights along the way of the first visit (the smallest parent's)."""
    state = materialise(_seed(edges.sparkSession, start, depth=(0, "int"), value=(float(value), "double")), "propagate")
    seen, frontier = state, state
    for hop in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("src"), "value"), "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        step = step.groupBy(F.col("dst").alias("id")).agg(F.min_by(F.col("value") * F.coalesce("weight", F.lit(1.0)), F.struct("src", "kind")).alias("value"))
        frontier = materialise(step.select("id", F.lit(hop).alias("depth"), "value"), "propagate")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def guard_cost(edges: DataFrame, nodes: DataFrame, depth: int, threshold: int) -> float:
    """The estimated frontier, average degree to the power of the depth; an error beyond ``threshold``."""
    n = nodes.count()
    estimate = (edges.count() / n) ** depth if n else 0.0
    if estimate > threshold:
        raise CostThresholdExceeded(f"an estimated frontier of {estimate:.0f} nodes, more than {threshold}")
    return estimate
