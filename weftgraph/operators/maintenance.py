"""Maintenance over node tables: expiry, retention, eviction, contradictions, consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def expired(nodes: DataFrame, now_ms: int, kind: str | None = None) -> DataFrame:
    """Ids of the nodes whose time is over."""
    rule = F.col("__expires_at__").isNotNull() & (F.col("__expires_at__") > 0) & (F.col("__expires_at__") < now_ms)
    if kind is not None:
        rule &= F.col("kind") == kind
    return nodes.filter(rule).select("id")


def eviction_order(nodes: DataFrame, limit: int, protected: tuple[str, ...] = ("schema", "config", "system")) -> DataFrame:
    """The ``limit`` ids to go first: the oldest update first, never updated last, protected kinds never."""
    return nodes.filter(~F.col("kind").isin(*protected)).orderBy(F.col("__updated_at__").asc_nulls_last(), "id").limit(limit).select("id", "__updated_at__")


def retained(nodes: DataFrame, now_ms: int, archive_days: int = 90, delete_days: int = 365) -> DataFrame:
    """``nodes`` with the next ``__blob_state__``: warm, archived after 90 days, deleted after 365."""
    age = F.lit(now_ms) - F.coalesce("__updated_at__", F.lit(now_ms))
    state = F.col("__blob_state__")
    nxt = F.when((state == "warm") & (age > archive_days * DAY_MS), "archived").when((state == "archived") & (age > delete_days * DAY_MS), "deleted").otherwise(state)
    return nodes.withColumn("__blob_state__", nxt)


def contradictions(nodes: DataFrame, field: str, by: str) -> DataFrame:
    """``group, n_values, n_nodes, low, high`` of the groups with more than one value of ``field``.

    Counts and ends are partial aggregates, so a large group is never gathered; ``collect_set`` is left to whoever needs all values.
    """
    out = nodes.filter(F.col(by).isNotNull() & F.col(field).isNotNull()).groupBy(F.col(by).alias("group"))
    return out.agg(F.count_distinct(field).alias("n_values"), F.count(F.lit(1)).alias("n_nodes"), F.min(field).alias("low"), F.max(field).alias("high")).filter("n_values > 1")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, kind, n``: nodes and edges for each kind."""
    n = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), "kind", "n")
    return n.unionByName(edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), "kind", "n"))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: stale edges (an end is missing) and their share."""
    ids = nodes.select("id")
    good = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    one = F.count(F.lit(1)).cast("long")
    counted = edges.agg(one.alias("n_edges"), F.lit(0).cast("long").alias("n_good")).unionByName(good.agg(F.lit(0).cast("long").alias("n_edges"), one.alias("n_good")))
    return counted.agg(F.sum("n_edges").alias("n_edges"), (F.sum("n_edges") - F.sum("n_good")).alias("n_stale"))


def consolidate(mentions: DataFrame, threshold: float = 0.7, min_size: int = 2) -> DataFrame:
    """``entity, cluster, members, confidence``: greedy centroid clusters of the vectors that mention an entity.

    ``mentions`` has entity, id, embedding. A member joins the nearest centroid of at least ``threshold``, in order of id. Vectors of one
    entity stream through one task in order, which holds centroids and ids only.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    schema = "entity string, cluster int, members array<string>, confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        current, sums, members = None, [], []

        def close() -> None:
            k = 0
            for m in members:
                if len(m) >= min_size:
                    rows.append({"entity": current, "cluster": k, "members": m, "confidence": min(1.0, len(m) / 5)})
                    k += 1

        for batch in batches:
            for row in batch.to_pylist():
                if row["entity"] != current:
                    close()
                    current, sums, members = row["entity"], [], []
                v = np.asarray(row["embedding"], float)
                v = v / (np.linalg.norm(v) or 1.0)
                near = [float(s @ v / (np.linalg.norm(s) or 1.0)) for s in sums]
                best = int(np.argmax(near)) if near else -1
                if best >= 0 and near[best] >= threshold:
                    sums[best] = sums[best] + v
                    members[best].append(row["id"])
                else:
                    sums.append(v)
                    members.append([row["id"]])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_CLUSTERS)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_CLUSTERS)

    _CLUSTERS = pa.schema([("entity", pa.string()), ("cluster", pa.int32()), ("members", pa.list_(pa.string())), ("confidence", pa.float64())])
    dealt = mentions.filter("entity is not null and embedding is not null").select("entity", "id", "embedding").repartition("entity").sortWithinPartitions("entity", "id")
    return dealt.mapInArrow(run, schema)
