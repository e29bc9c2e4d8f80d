"""Statements of memory: REMEMBER, ANSWER, CONNECT NODE, INGEST, and the vectors behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import public, visible_edges
from ..errors import EmbedderRequired, NodeExists, QueryError, VectorNotFound
from ..functions.embed import embedded
from ..functions.temporal import parse_date_range
from ..functions.text import chunk_by_heading, split_sentences, summary
from ..operators import maintenance as M
from ..operators import retrieval as R
from ..operators import writes as W
from ..sources import readers
from ..storage import materialise

PARENTS = ("parent_chunk", "parent_node", "parent_id")
#: Fixed value: candidates that are fused at most, so what is ranked in one place is small.
MAX_CANDIDATES = 200


def _chunks(largest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, h, b) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (h, b) in enumerate(chunk_by_heading(t or "", largest))]
            parts = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.string()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.string()), pa.array(parts[3], pa.string())], names=["path", "place", "heading", "text"])

    return run


class MemoryStatements:
    """Part of ``Engine``."""

    def _similar_scores(self, text: str) -> DataFrame:
        """``id, __similarity`` of every vector to a text."""
        if self.catalog.vectors is None:
            raise VectorNotFound("the catalog has no vectors")
        if self.embed is None:
            raise EmbedderRequired("SIMILAR needs an embedder")
        target = F.array(*[F.lit(float(x)) for x in self.embed(text)])
        return self.catalog.vectors.select("id", R.cosine(F.col("embedding"), target).alias("__similarity"))

    def _legs(self, text: str, most: int, nodes: DataFrame) -> DataFrame:
        """``id, vec, bm25``: the best of each leg, given to the parents of sentences and chunks."""
        c, spark = self.catalog, nodes.sparkSession
        held = [F.col(p) for p in PARENTS if p in nodes.columns]
        owner = nodes.select("id", F.coalesce(*held, F.col("id")).alias("__owner"))
        vec, lex = spark.createDataFrame([], "id string, vec double"), spark.createDataFrame([], "id string, bm25 double")
        if c.vectors is not None and self.embed is not None:
            live = c.vectors.join(owner, "id")
            found = [R.similar_to(live, self.embed(s), most) for s in split_sentences(text) or [text]]
            vec = reduce(DataFrame.unionByName, found).groupBy(F.col("__owner").alias("id")).agg(F.max(F.greatest("_similarity_score", F.lit(0.0))).alias("vec"))
        if c.documents is not None:
            hits = R.bm25(c.documents, text, "id", "text", stemmed=self.config.stemming).join(owner, "id").orderBy("_bm25_score", "id").limit(most)
            lex = hits.groupBy(F.col("__owner").alias("id")).agg(F.max(-F.col("_bm25_score")).alias("bm25"))
        return vec.join(lex, "id", "full_outer")

    def _mention_weight(self, found: DataFrame) -> DataFrame:
        mentions = visible_edges(self.catalog, "mentions")
        degree = mentions.groupBy("dst").agg(F.log1p(F.count(F.lit(1))).alias("d"))
        near = mentions.join(found.select(F.col("id").alias("src")), "src").join(degree, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("d").alias("graph"))
        return found.join(near, "id", "left")

    def _fused(self, text: str, at: Any, tokens: int | None, limit: int | None, rule: Any) -> DataFrame:
        """The rows of REMEMBER in order, without its side effect."""
        k, cfg, nodes = limit or 10, self.config, self.nodes
        if self.catalog.documents is None and (self.catalog.vectors is None or self.embed is None):
            raise QueryError("REMEMBER needs documents, or vectors and an embedder")
        most = k * cfg.search_oversample
        legs = materialise(self._legs(text, most, nodes), "legs")
        top = legs.agg(F.max("bm25")).first()[0] or 1.0
        seen = F.coalesce("vec", F.lit(0.0)) + F.coalesce("bm25", F.lit(0.0)) / F.lit(top)
        cap = min(len(split_sentences(text) or [text]) * most, MAX_CANDIDATES)
        found = legs.join(nodes, "id").orderBy(seen.desc(), "id").limit(cap)
        has = lambda c, t: F.col(c) if c in nodes.columns else F.lit(None).cast(t)
        event, updated = has("__event_at__", "long"), F.when(has("__event_at__", "long").isNull(), has("__updated_at__", "long"))
        found = found.withColumns({"__event": event, "__update": updated, "recall_count": has("__recall_count__", "long")})
        found = self._mention_weight(found) if cfg.graph_signal else found.withColumn("graph", F.lit(0.0))
        found = materialise(found, "candidates")
        last = found.agg(F.max("__event").alias("e"), F.max("__update").alias("u")).first()
        # ages are relative to the newest of their own kind
        found = found.withColumn("event_ms", -F.coalesce(F.lit(last.e) - F.col("__event"), F.lit(last.u) - F.col("__update")))
        w = list(cfg.remember_weights)
        if len(w) == 3:
            w = [w[0], w[1], 0.0, w[2]] if cfg.graph_signal else [*w, 0.0]
        scored = R.remember(found, w, cfg.recency_half_life_days)
        if cfg.fusion_method == "rrf":
            signals = ["_vector_sim", "_bm25_score", "_recency_score", *(["_graph_score"] if cfg.graph_signal else [])]
            scored = scored.join(R.rrf(scored, signals, k=cfg.rrf_k), "id").withColumn("_remember_score", F.round(F.col("rrf") + F.col("_recall_boost") + F.col("_co_bonus"), 4)).drop("rrf")
        if at is not None and "__event_at__" in nodes.columns:
            start, end = (at, at) if isinstance(at, (int, float)) else parse_date_range(at, self._now())
            inside = F.col("__event").isNotNull()
            inside &= F.lit(True) if start is None else F.col("__event") >= start
            inside &= F.lit(True) if end is None else F.col("__event") <= end
            dated = found.select("id", inside.cast("double").alias("__in"))
            scored = scored.join(dated, "id").withColumn("_remember_score", F.col("_remember_score") * F.col("__in")).drop("__in")
        out = self._where(rule, nodes).join(scored, "id")
        if self.catalog.documents is not None:
            ids = F.broadcast(scored.select("id"))
            out = out.join(self.catalog.documents.join(ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("_document")), "id", "left")
        if tokens is not None:
            long = reduce(lambda a, b: a + b, [F.coalesce(F.length(c), F.lit(0)) for c in ("summary", "claim", "_document") if c in out.columns] or [F.lit(0)])
            before = Window.partitionBy(F.lit(0)).orderBy(F.desc("_remember_score"), "id").rowsBetween(Window.unboundedPreceding, -1)
            out = out.withColumn("__spent", F.coalesce(F.sum(F.floor(long / 4)).over(before), F.lit(0))).filter(F.col("__spent") < tokens).drop("__spent")
        out = out.withColumn("_rank_stage", F.lit("fusion"))
        order = [F.desc("_remember_score"), F.col("id")]
        if self.rerank is not None:
            out = materialise(out, "ranked")
            given = [(r.id, r.asDict().get("_document") or "") for r in out.select([c for c in ("id", "_document") if c in out.columns]).collect()]
            if len(given) > k:
                scores = [(i, float(s)) for (i, _), s in zip(given, self.rerank(text, [t for _, t in given]), strict=True)]
                out = out.drop("_rank_stage").join(nodes.sparkSession.createDataFrame(scores, "id string, _rerank_score double"), "id").withColumn("_rank_stage", F.lit("rerank"))
                order = [F.desc("_rerank_score"), F.col("id")]
        return out.orderBy(*order).limit(k)

    def _remember(self, text, at, tokens, limit, rule) -> DataFrame:
        """Ranked rows; each one's recall count goes up, which the next REMEMBER sees."""
        out = materialise(self._fused(text, at, tokens, limit, rule), "remembered")
        ids = [r.id for r in out.select("id").collect()]
        nodes = self.catalog.nodes
        if ids:
            hit = F.col("id").isin(ids)
            old = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("long")
            count = F.when(hit, F.coalesce(old("__recall_count__"), F.lit(0)) + 1).otherwise(old("__recall_count__")).cast("long")
            self._put(nodes.withColumns({"__recall_count__": count, "__last_recalled_at__": F.when(hit, F.lit(self._now())).otherwise(old("__last_recalled_at__")).cast("long")}))
        order = "_rerank_score" if "_rerank_score" in out.columns else "_remember_score"
        return public(out).orderBy(F.desc(order), "id")

    def _answer(self, text, at, tokens, limit, rule, using) -> DataFrame:
        """``answer, sources`` of a reader (a callable of question and passages) over what REMEMBER gives."""
        name = using or "default"
        if name not in self.readers:
            raise QueryError(f"no reader {name!r}; there are {', '.join(sorted(self.readers)) or 'none'}")
        rows = self._remember(text, at, tokens, limit, rule).collect()
        passages = [(r.id, d.get("_document") or d.get("summary") or "") for r in rows for d in [r.asDict()]]
        pool = ThreadPoolExecutor(1)
        try:
            answer = pool.submit(self.readers[name], text, passages).result(timeout=self.config.reader_timeout_s)
        except TimeoutError as e:
            raise QueryError(f"reader {name!r} gave no answer in {self.config.reader_timeout_s} s") from e
        finally:
            pool.shutdown(wait=False)
        return self.catalog.nodes.sparkSession.createDataFrame([(str(answer), [i for i, _ in passages])], "answer string, sources array<string>")

    def _connect_node(self, id, threshold) -> None:
        """``similar_to`` edges to those of the ten nearest whose similarity is ``threshold`` or more."""
        self._known(id)
        near = self._similar(("node", id), 10, None).filter((F.col("_similarity_score") >= threshold) & (F.col("id") != id))
        self._link(near.select(F.lit(id).alias("src"), F.col("id").alias("dst"), F.lit("similar_to").alias("kind"), F.col("_similarity_score").alias("weight")))

    def _link(self, found: DataFrame) -> None:
        """Add edges; one that is there stays as it is."""
        edges = self.catalog.edges
        fresh = found.join(edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
        self.catalog = self.catalog.with_tables(edges=edges.unionByName(fresh.select([c for c in fresh.columns if c in edges.columns]), allowMissingColumns=True))

    def _text_of(self, nodes: DataFrame) -> Column:
        named = [d["embed"] for d in self.kinds.nodes.values() if d["embed"]]
        fields = [F.col(f"`{c}`").cast("string") for c in ("_document", "summary", *dict.fromkeys(named)) if c in nodes.columns]
        return F.coalesce(*fields) if fields else F.lit(None).cast("string")

    def _sys_embedders(self) -> DataFrame:
        rows = [] if self.embed is None else [(getattr(self.embed, "__name__", type(self.embed).__name__), len(self.embed("x")))]
        return self.catalog.nodes.sparkSession.createDataFrame(rows, "name string, dims int")

    def _sys_reembed(self) -> None:
        """New vectors for every visible node with a text: its document, its summary, or its kind's embed field."""
        if self.embed is None:
            raise EmbedderRequired("SYS REEMBED needs an embedder")
        c, nodes = self.catalog, self.nodes
        if c.documents is not None:
            nodes = nodes.join(c.documents.groupBy("id").agg(F.first("text").alias("_document")), "id", "left")
        fresh = materialise(embedded(nodes.select("id", self._text_of(nodes).alias("text")), self.embed), "vectors")
        kept = fresh if c.vectors is None else fresh.unionByName(c.vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).join(fresh, "id", "left_anti"))
        self.catalog = c.with_tables(vectors=kept)

    def _sys_consolidate(self, threshold, smallest) -> DataFrame:
        """Observations of the clusters of nodes that mention one entity, with ``evidence`` edges to their members."""
        if self.catalog.vectors is None:
            raise VectorNotFound("the catalog has no vectors")
        mentions = visible_edges(self.catalog, "mentions").select(F.col("src").alias("id"), F.col("dst").alias("entity"))
        found = M.consolidate(mentions.join(self.catalog.vectors.select("id", "embedding"), "id"), threshold, smallest)
        found = materialise(found.withColumn("obs", F.concat_ws(":", F.lit("obs"), "entity", "cluster")), "clusters")
        spread = found.select("obs", F.explode("members").alias("dst"))
        told = spread.join(self.nodes.withColumnRenamed("id", "dst"), "dst")
        docs = self.catalog.documents
        told = told.join(docs.groupBy("id").agg(F.first("text").alias("_document")).withColumnRenamed("id", "dst"), "dst", "left") if docs is not None else told
        text = self._text_of(told)
        event = F.min("__event_at__") if "__event_at__" in told.columns else F.min(F.lit(None).cast("long"))
        body = told.groupBy("obs").agg(F.max_by(text, F.struct(F.coalesce(F.length(text), F.lit(-1)), "dst")).alias("text"), event.alias("__event_at__"))
        now = F.lit(self._now())
        rows = found.join(body, "obs", "left").select(
            F.col("obs").alias("id"), F.lit("observation").alias("kind"), F.col("entity"), "text", F.size("members").cast("long").alias("members"),
            F.col("confidence").alias("__confidence__"), "__event_at__", now.alias("__created_at__"), now.alias("__updated_at__"),
        )
        rest = self.catalog.nodes.join(rows.select("id"), "id", "left_anti")
        self._put(W.widened(rest, rows))
        self._link(spread.select(F.col("obs").alias("src"), "dst", F.lit("evidence").alias("kind"), F.lit(1.0).alias("weight")))
        return public(rows)

    def _ingest(self, path, as_id, kind, using, vision) -> DataFrame:
        """Files to a node each, chunks of them with their texts, ``has_chunk`` and ``next`` edges; rows of tables are chunks.

        What can't be read (an unknown form, or none at ``path``) is an error and changes nothing.
        """
        spark = self.catalog.nodes.sparkSession
        if vision is not None:
            describe: Callable | None = self.readers.get(vision)
            if describe is None:
                raise QueryError(f"no reader {vision!r} for images")
            content = bytes(readers.binary(spark, path).first().content)
            given = spark.createDataFrame([(path, str(describe(path, content)))], "path string, text string")
        else:
            given = readers.read(spark, path, using)
        if {"path", "text"} <= set(given.columns):
            parts = given.select("path", "text").mapInArrow(_chunks(self.config.chunk_size), "path string, place long, heading string, text string")
        elif "content" in given.columns:
            raise QueryError(f"{path} needs a reader that gives its text")
        else:
            row = given.select(F.to_json(F.struct("*")).alias("text"))
            parts = row.select(F.lit(path).alias("path"), F.monotonically_increasing_id().alias("place"), F.lit("").alias("heading"), "text")
        name = F.lit(as_id) if as_id else F.concat(F.lit("doc:"), F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 12))
        if as_id and given.columns[:2] == ["path", "text"] and given.select("path").distinct().limit(2).count() > 1:
            raise QueryError("AS names one node, and the path has several files")
        parts = materialise(parts.withColumn("parent", name).withColumn("id", F.concat_ws(":", "parent", F.lit("chunk"), "place")), "chunks")
        parents = parts.groupBy(F.col("parent").alias("id")).agg(F.first("path").alias("source"), F.count(F.lit(1)).alias("n_chunks"))
        if clash := self.catalog.nodes.join(parents.select("id"), "id", "left_semi").select("id").first():
            raise NodeExists(clash.id)
        now, bound = F.lit(self._now()), {k: F.lit(v) for k, v in self._bound({})[1].items()}
        stamps = {"__created_at__": now, "__updated_at__": now, "__blob_state__": F.lit("warm"), **bound}
        heads = parents.withColumns({"kind": F.lit(kind or "document"), "parser": F.lit((using or path.rpartition(".")[2]).lower()), **stamps})
        body = parts.select("id", F.lit("chunk").alias("kind"), F.col("parent").alias("parent_node"), "heading", summary(F.col("text"), self.config.summary_chars).alias("summary"), F.col("place").alias("position")).withColumns(stamps)
        self._put(W.widened(W.widened(self.catalog.nodes, heads), body))
        after = F.lead("id").over(Window.partitionBy("parent").orderBy("place"))
        follows = parts.select(F.col("id").alias("src"), after.alias("dst"), F.lit("next").alias("kind"), F.lit(1.0).alias("weight")).filter("dst is not null")
        self._link(parts.select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("has_chunk").alias("kind"), F.lit(1.0).alias("weight")).unionByName(follows))
        c, texts = self.catalog, parts.select("id", "text")
        self.catalog = c.with_tables(documents=texts if c.documents is None else c.documents.unionByName(texts, allowMissingColumns=True))
        if self.embed is not None:
            fresh = materialise(embedded(texts, self.embed), "vectors")
            self.catalog = self.catalog.with_tables(vectors=fresh if c.vectors is None else c.vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(fresh))
        return parents
