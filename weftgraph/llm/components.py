"""Connected components of a link table: in one task while links are few, else by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialise, release_memory

#: One task takes up to this many links (about 150 MB); rounds of joins would cost more in small tasks and plans than in work.
MAX_LINKS = 1_000_000


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b), and the smallest node of each one's component: roots are hooked on smaller ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        x, y = label[u], label[v]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (jump := label[label])).any():
            label = jump
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[label]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    for batch in batches:
        for end, column in zip(ends, batch.columns, strict=True):
            end.append(column.to_numpy(zero_copy_only=False))
    nodes, labels = labelled(*map(np.concatenate, ends))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["node", "label"])
    release_memory()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` (smallest node of its component) for every node of ``links`` (a, b: long)."""
    if links.count() > MAX_LINKS:
        return by_rounds(links)
    return materialise(links.select("a", "b").coalesce(1).mapInArrow(_labelled, "node long, label long"), "labels")


def by_rounds(links: DataFrame) -> DataFrame:
    """``components`` of any number of links.

    Each round takes the least label among the neighbours and then the label of that
    label, so a component of diameter d needs about log d rounds. Nodes of high degree
    are joined without a shuffle of their rows.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a"))
    edges = materialise(both.filter("src != dst").distinct(), "edges")
    total = edges.count()
    labels = materialise(edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree")).withColumn("label", F.col("node")), "labels")
    while total:
        near = join_groups(edges, labels.withColumnRenamed("node", "dst"), "dst", "degree", total)
        best = near.groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        step = materialise(
            labels.join(best, "node").select("node", "degree", "label", F.least("label", "near").alias("next")), "step"
        )
        sizes = step.groupBy("next").agg(F.count(F.lit(1)).alias("__size"))
        roots = step.select(F.col("node").alias("next"), F.col("next").alias("jump")).join(sizes, "next")
        fresh = materialise(
            join_groups(step, roots, "next", "__size", total).select("node", "degree", F.col("label").alias("old"), F.col("jump").alias("label")),
            "labels",
        )
        changed = fresh.filter("old != label").limit(1).count()
        labels = fresh.select("node", "degree", "label")
        if not changed:
            break
    return labels.select("node", "label")
