"""Vector, lexical and fused retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..storage import materialise

DAY_MS = 86_400_000
#: Sign bits of a band at most, and the chance to miss a near pair.
MAX_BITS = 24
MISS = 1e-6
TOKEN = r"[\p{L}\p{N}_]+"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similar_to(vectors: DataFrame, query: list[float], limit: int = 10, rule: Column | None = None, vec: str = "embedding", ident: str = "id") -> DataFrame:
    """The ``limit`` nearest vectors with ``_similarity_score``; a predicate is applied before the top-k is taken."""
    target = F.array(*[F.lit(float(x)) for x in query])
    found = (vectors if rule is None else vectors.filter(rule)).withColumn("_similarity_score", F.round(cosine(F.col(vec), target), 4))
    return found.orderBy(F.desc("_similarity_score"), ident).limit(limit)


def binary_codes(vec: Column) -> Column:
    """Sign bits as a string of 0 and 1."""
    return F.array_join(F.transform(vec, lambda x: F.when(x >= 0, "1").otherwise("0")), "")


def _banding(threshold: float, n: int) -> tuple[int, int]:
    """Sign bits a band, and bands, for ``n`` vectors: about one vector a bucket by chance, and a miss of 1e-6 for a pair of ``threshold``."""
    same = 1 - np.arccos(min(1.0, threshold)) / np.pi
    bits = max(2, min(MAX_BITS, int(np.ceil(np.log2(max(n, 2))))))
    return bits, int(np.ceil(np.log(MISS) / np.log1p(-(same**bits)))) if same < 1 else 1


def _distinct_pairs(slim: DataFrame, threshold: float, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``v, id, n`` of the distinct vectors of ``slim`` (id, v), the id being the least, and their ``a, b, similarity`` of at least ``threshold``.

    Sign random projections deal the vectors into the buckets of many bands; only vectors of one bucket are compared, exactly.
    """
    unique = materialise(slim.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "unique")
    bits, bands = _banding(threshold, unique.count())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.asarray(v, float)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(seed).standard_normal((len(x), bits * bands))
                signs = (x @ planes[len(x)] > 0).reshape(bands, bits)
                out.append((signs @ (1 << np.arange(bits)) + np.arange(bands) * (1 << bits)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "keys"])

    dealt = unique.select("id", "v").mapInArrow(keys, "id string, keys array<long>").select("id", F.explode("keys").alias("key"))
    dealt = materialise(dealt, "bands")
    met = dealt.withColumnRenamed("id", "a").join(dealt.withColumnRenamed("id", "b"), "key").filter("a < b").select("a", "b").distinct()
    sized = unique.select("id", "v", norm(F.col("v")).alias("size"))
    left = sized.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("size").alias("na"))
    right = sized.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("size").alias("nb"))
    similarity = dot(F.col("va"), F.col("vb")) / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0))
    close = met.join(left, "a").join(right, "b").select("a", "b", similarity.alias("similarity"))
    return unique, close.filter(F.col("similarity") >= threshold)


def _slim(vectors: DataFrame, ident: str, vec: str) -> DataFrame:
    return vectors.select(F.col(ident).cast("string").alias("id"), F.col(vec).alias("v")).filter("v is not null")


def near_pairs(vectors: DataFrame, threshold: float, ident: str = "id", vec: str = "embedding", seed: int = 7) -> DataFrame:
    """``a, b, similarity`` of the pairs of at least ``threshold`` (a < b), up to a chance of about 1e-6 a pair.

    Equal vectors are compared once and meet through their smallest id.
    """
    slim = _slim(vectors, ident, vec)
    unique, close = _distinct_pairs(slim, threshold, seed)
    equal = slim.join(unique.filter("n > 1").select(F.col("id").alias("a"), "v"), "v").filter("a < id")
    return close.unionByName(equal.select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def nearest(vectors: DataFrame, threshold: float, top: int, ident: str = "id", vec: str = "embedding", least: bool = True) -> DataFrame:
    """``a, b, similarity``: the ``top`` nearest others of each node, of at least ``threshold``; of equals those of the least (or else largest) id.

    Distinct vectors are compared once. A node's others are among the first ``top + 1`` nodes of its own vector and
    the best ``top`` of the first ``top`` of each near vector, so equal vectors share one short list.
    """
    slim = _slim(vectors, ident, vec).filter("id is not null").distinct()
    unique, close = _distinct_pairs(slim, threshold)
    by_id = F.col("id") if least else F.desc("id")
    groups = unique.select("v", F.col("id").alias("g"))
    several = slim.join(unique.filter("n > 1").select("v", F.col("id").alias("g")), "v")
    placed = several.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy(by_id)).alias("place")).filter(F.col("place") <= top + 1)
    lone = unique.filter("n = 1").select(F.col("id").alias("g"), "id", F.lit(1).alias("place"))
    firsts = materialise(placed.unionByName(lone), "firsts")
    both = close.select(F.col("a").alias("of"), F.col("b").alias("g"), "similarity").unionByName(close.select(F.col("b").alias("of"), F.col("a").alias("g"), "similarity"))
    spread = both.join(firsts.filter(F.col("place") <= top), "g").select("of", "id", "similarity")
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("similarity"), by_id))
    others = spread.withColumn("rank", rank).filter(F.col("rank") <= top).select("of", "id", "similarity")
    own = firsts.join(groups, "g").select(F.col("g").alias("of"), "id", F.coalesce(cosine(F.col("v"), F.col("v")), F.lit(1.0)).alias("similarity"))
    key = -F.col("similarity") if least else F.col("similarity")
    lists = own.unionByName(others).groupBy("of").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), "id", "similarity")), asc=least).alias("near"))
    lists = materialise(groups.join(lists.withColumnRenamed("of", "g"), "g").select("v", "near"), "nearest")
    found = slim.join(lists, "v").select(F.col("id").alias("a"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, top).alias("near"))
    return found.select("a", F.explode("near").alias("x")).select("a", F.col("x.id").alias("b"), F.col("x.similarity").alias("similarity"))


def duplicates(vectors: DataFrame, threshold: float = 0.95, ident: str = "id", vec: str = "embedding") -> DataFrame:
    """``a, b, similarity``: for each node its nearest other, of at least ``threshold``, as unordered pairs."""
    pairs = nearest(vectors, threshold, 1, ident, vec, least=False)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("similarity", 4).alias("similarity")).distinct()


def connect(vectors: DataFrame, threshold: float = 0.85, top: int = 10, ident: str = "id", vec: str = "embedding") -> DataFrame:
    """``src, dst, weight``: the ``top`` nearest others of each node, of at least ``threshold``."""
    pairs = nearest(vectors, threshold, top, ident, vec)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round("similarity", 4).alias("weight"))


def query_terms(text: str) -> list[str]:
    """Distinct lower-case words of a query, without the operators."""
    import regex

    words = [w for w in regex.findall(TOKEN, text) if w not in ("AND", "OR", "NOT", "NEAR")]
    return list(dict.fromkeys(w.lower() for w in words))


def _stem_counts(stems: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[stem(w) for w in words] for words in batch.column(2).to_pylist()]
            counts = [pa.array([float(words.count(s)) for words in found], pa.float64()) for s in stems]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], names=["id", "dl", *(f"tf{i}" for i in range(len(stems)))])

    return run


def bm25(docs: DataFrame, text: str, ident: str = "doc_id", body: str = "text", k1: float = 1.2, b: float = 0.75, stemmed: bool = False) -> DataFrame:
    """``id, _bm25_score`` of the documents with a term of the query; negative, smaller is better.

    The idf is ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Lengths and frequencies come from two scans
    without a shuffle of texts; the statistics are one row. If ``stemmed``, words meet by their stems, and only words
    that begin like one of the query's stems leave the JVM.
    """
    terms = query_terms(text)
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(body), F.lit(""))), F.lit(TOKEN), F.lit(0))
    count = lambda w: F.size(F.filter("words", lambda x: x == w)).cast("double")
    counted = docs.select(F.col(ident).alias("id"), words.alias("words"))
    if stemmed and terms:
        terms = list(dict.fromkeys(map(stem, terms)))
        # a stem differs from its words' beginning by its last letter at most
        heads = sorted({t[:-1] or t for t in terms})
        like = lambda x: reduce(lambda a, c: a | c, [x.startswith(h) for h in heads])
        kind = docs.schema[ident].dataType.simpleString()
        schema = f"id {kind}, dl double" + "".join(f", tf{i} double" for i in range(len(terms)))
        slim = counted.select("id", F.size("words").cast("double").alias("dl"), F.filter("words", like).alias("words"))
        counted = slim.mapInArrow(_stem_counts(terms), schema)
    else:
        counted = counted.select("id", F.size("words").cast("double").alias("dl"), *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))])
    one = stats.first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = one[f"df{i}"] or 0.0
        idf = max(float(np.log((one.n - df + 0.5) / (df + 0.5))), 1e-6) if one.n else 0.0
        tf = F.col(f"tf{i}")
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(one.avgdl or 1.0)))
    return counted.withColumn("_bm25_score", -score).filter(F.col("_bm25_score") < 0).select("id", "_bm25_score")


def recency(age_ms: Column, half_life_days: float) -> Column:
    return F.exp(-(age_ms / DAY_MS) / half_life_days)


def _places(scored: DataFrame, signal: str) -> DataFrame:
    """``signal, place`` of each positive value: its rank from the top, ties having their average rank.

    Values are counted, dealt into ranges and ranked inside these, so no task holds more than a range of values; only the ranges' totals meet.
    """
    counts = scored.filter(F.col(signal) > 0).groupBy(signal).agg(F.count(F.lit(1)).alias("__n"))
    dealt = materialise(counts.repartitionByRange(F.desc(signal)).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__part").agg(F.sum("__n").alias("__total"))
    above = totals.select("__part", (F.sum("__total").over(Window.orderBy("__part")) - F.col("__total")).alias("__above"))
    inside = F.sum("__n").over(Window.partitionBy("__part").orderBy(F.desc(signal)))
    return dealt.join(F.broadcast(above), "__part").select(signal, (F.col("__above") + inside - F.col("__n") + 1 + (F.col("__n") - 1) / 2).alias("__place"))


def rrf(scored: DataFrame, signals: list[str], ident: str = "id", k: int = 60) -> DataFrame:
    """``id, rrf``: the sum of 1 / (k + rank), ties having their average rank; a signal that is null or not positive ranks last.

    Rows are written once and joined with the places of their values; no rank is taken over all rows in one task.
    """
    out = materialise(scored.select(ident, *signals), "scored")
    last, total = F.lit(out.count()), F.lit(0.0)
    scores = out
    for s in signals:
        out = out.join(_places(scores, s).withColumnRenamed("__place", f"__r_{s}"), s, "left")
        total = total + 1 / (k + F.coalesce(F.col(f"__r_{s}"), last))
    return out.select(ident, total.alias("rrf"))


def remember(candidates: DataFrame, weights: list[float], half_life_days: float) -> DataFrame:
    """Fuse id, vec, bm25 (positive), event_ms, graph, recall_count into ``_remember_score``, one projection after two one-row statistics."""
    top = candidates.agg(F.max("bm25").alias("b"), F.max("event_ms").alias("t"), F.max("graph").alias("g")).first()
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    vec = F.greatest(zero("vec"), F.lit(0.0))
    lex = zero("bm25") / float(top.b) if top.b else F.lit(0.0)
    rec = F.coalesce(recency(F.lit(top.t or 0) - F.col("event_ms"), half_life_days), F.lit(0.0))
    graph = zero("graph") / float(top.g) if top.g else F.lit(0.0)
    bonus = F.when((vec > 0) & (lex > 0), 0.10 * F.least(vec, lex)).otherwise(0.0)
    boost = 0.05 * F.log1p(zero("recall_count"))
    score = weights[0] * vec + weights[1] * lex + weights[2] * rec + weights[3] * graph + boost + bonus
    return candidates.select(
        "id", F.round(score, 4).alias("_remember_score"), F.round(vec, 4).alias("_vector_sim"), F.round(lex, 4).alias("_bm25_score"),
        F.round(rec, 4).alias("_recency_score"), F.round(graph, 4).alias("_graph_score"), F.round(bonus, 4).alias("_co_bonus"), F.round(boost, 4).alias("_recall_boost"),
    )
