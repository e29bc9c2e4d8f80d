"""Carries out statements against a catalog: reads give a lazy DataFrame, writes give a new catalog version."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, alive, public, visible_edges, visible_nodes
from ..config import Config
from ..errors import BatchRollback, EmbedderRequired, NodeNotFound, QueryError, VectorNotFound
from ..functions.text import auto_id, split_sentences
from ..operators import graph as G
from ..operators import maintenance as M
from ..operators import predicates as P
from ..operators import retrieval as R
from ..operators import writes as W
from ..storage import materialise
from .admin import AdminStatements
from .memory import MemoryStatements
from .parser import Statement, parse
from .vault import VaultStatements


class Engine(MemoryStatements, AdminStatements, VaultStatements):
    """``execute`` takes one statement, or several between BEGIN and COMMIT of which all or none take effect.

    ``embed`` maps a text to a vector, ``rerank`` a question and texts to scores, ``readers`` a name to a callable for ANSWER;
    ``vault`` is a folder of notes and ``folder`` that of checkpoints. ``log`` holds the writes with the time and session
    they ran under, so ``replay`` gives the same tables; ``trace`` marks what runs in the query log.
    """

    def __init__(
        self, catalog: Catalog, config: Config | None = None, embed: Callable | None = None, rerank: Callable | None = None,
        readers: dict[str, Callable] | None = None, vault: str | None = None, folder: str | None = None,
    ) -> None:
        self.catalog, self.config, self.embed = catalog, config or Config(), embed
        self.rerank, self.readers, self.vault, self.folder = rerank, dict(readers or {}), vault, folder
        self.snapshots: dict[str, Catalog] = {}
        self.log: list[tuple[str, Any]] = []
        self.trace: str | None = None
        self._since = self._saved = self._depth = 0
        self._base, self._begun = catalog, {}
        self._start_admin()

    def execute(self, text: str) -> DataFrame | None:
        lines = [x.strip() for x in text.strip().splitlines() if x.strip()]
        if lines and lines[0] == "BEGIN":
            return self._batch(lines)
        began, verb, before = time.perf_counter(), "", self.catalog
        try:
            statement = parse(text, self._now())
            verb = statement.verb
            out = self._carry_out(text, statement)
        except Exception as e:
            self._note(text, verb, (time.perf_counter() - began) * 1000, False, e)
            raise
        self._note(text, verb, (time.perf_counter() - began) * 1000, self.catalog is not before)
        return out

    def _carry_out(self, text: str, statement: Statement) -> DataFrame | None:
        session, before = self.catalog.session, self.catalog
        self._depth += 1
        try:
            out = getattr(self, f"_{statement.verb}")(**statement.args)
        finally:
            self._depth -= 1
        # a statement that another one runs is part of that one's entry
        if self.catalog is not before and not self._depth and not statement.verb.startswith("sys_wal"):
            self.log.append((text, session))
            self._cut()
        return out

    def _nested(self, text: str) -> DataFrame | None:
        return self._carry_out(text, parse(text, self._now()))

    def _batch(self, lines: list[str]) -> DataFrame | None:
        """``$name = CREATE NODE ...`` names a node that later lines may use as an end of an edge."""
        if lines[-1] != "COMMIT":
            raise QueryError("COMMIT expected")
        before, logged, out = self.catalog, len(self.log), None
        names: dict[str, str] = {}
        try:
            for line in lines[1:-1]:
                name, _, rest = line.partition("=")
                bound = name.strip() if line.startswith("$") else None
                statement = parse(rest if bound else line, self._now())
                for end in ("src", "dst"):
                    if str(statement.args.get(end, "")).startswith("$"):
                        if statement.args[end] not in names:
                            raise QueryError(f"{statement.args[end]} isn't bound")
                        statement.args[end] = names[statement.args[end]]
                self._depth += 1
                try:
                    made = getattr(self, f"_{statement.verb}")(**statement.args)
                finally:
                    self._depth -= 1
                if bound:
                    if statement.verb not in ("create", "upsert"):
                        raise QueryError(f"{bound} can only name a node that is made")
                    names[bound] = self._made
                else:
                    out = made
        except Exception as e:
            self.catalog = before
            del self.log[logged:]
            raise BatchRollback(str(e)) from e
        if self.catalog is not before:
            self.log.append(("\n".join(lines), before.session))
            self._cut()
        return out

    def replay(self, log: list[tuple[str, Any]]) -> None:
        for text, session in log:
            self.catalog = replace(self.catalog, session=session)
            self.execute(text)

    def _cut(self, every: int = 8) -> None:
        """Write the tables after some versions, so that plans stay short."""
        self._since += 1
        if self._since >= every:
            c = self.catalog
            kept = {k: materialise(v, k) for k in ("nodes", "edges", "vectors", "documents") if (v := getattr(c, k)) is not None}
            self.catalog, self._since = c.with_tables(**kept), 0

    # reads

    @property
    def nodes(self) -> DataFrame:
        return visible_nodes(self.catalog)

    def _where(self, rule: Any, nodes: DataFrame | None = None) -> DataFrame:
        nodes = self.nodes if nodes is None else nodes
        for leaf in P.leaves(rule) if rule is not None else []:
            if isinstance(leaf, P.Degree) and P.degree_column(leaf) not in nodes.columns:
                found = G.degrees(self.catalog.edges, leaf.incoming, leaf.kind).withColumnRenamed("degree", P.degree_column(leaf))
                nodes = nodes.join(found, "id", "left")
        texts = {leaf.text for leaf in P.leaves(rule) if isinstance(leaf, P.Similar)} if rule is not None else set()
        if len(texts) > 1:
            raise QueryError("one SIMILAR text a statement")
        for text in texts:
            nodes = nodes.join(self._similar_scores(text), "id", "left")
        return nodes.filter(P.compile_rule(nodes, rule))

    def _node(self, id: str, document: bool) -> DataFrame:
        out = self.nodes.filter(F.col("id") == id)
        if document and self.catalog.documents is not None:
            out = out.join(self.catalog.documents.select("id", F.col("text").alias("_document")), "id", "left")
        return public(out)

    def _nodes(self, rule, order, limit, offset) -> DataFrame:
        out = self._where(rule)
        out = out.orderBy(*P.order_by(out, *order)) if order else out.orderBy("id") if limit or offset else out
        out = out.offset(offset) if offset else out
        return public(out.limit(limit) if limit is not None else out)

    def _edges(self, end, id, rule, limit) -> DataFrame:
        edges = visible_edges(self.catalog).filter(F.col(end) == id)
        out = edges.filter(P.compile_rule(edges, rule))
        return out.orderBy("src", "dst", "kind").limit(limit) if limit is not None else out

    def _count(self, what, rule) -> DataFrame:
        table = self._where(rule) if what == "nodes" else visible_edges(self.catalog)
        table = table if what == "nodes" else table.filter(P.compile_rule(table, rule))
        return table.agg(F.count(F.lit(1)).alias("count"))

    def _aggregate(self, rule, by, aggs, having, order, limit) -> DataFrame:
        asked = [*aggs, *([having[0]] if having else []), *([order[0]] if order else [])]
        out = P.aggregate(self._where(rule), list(dict.fromkeys(asked)), by)
        if having:
            out = out.filter(P.OPS[having[1]](F.col(f"`{having[0][2]}`"), F.lit(having[2])))
        if order:
            c = F.col(f"`{order[0][2]}`")
            out = out.orderBy(c.desc_nulls_last() if order[1] else c.asc_nulls_last(), *by)
        out = out.limit(limit) if limit is not None else out
        return out.select(*by, *[F.col(f"`{a[2]}`") for a in aggs])

    def _traverse(self, start, depth, kind, limit) -> DataFrame:
        G.guard_cost(self.catalog.edges, self.catalog.nodes, depth, self.config.cost_threshold)
        out = G.traverse(self.catalog.edges, self.nodes, start, depth, kind)
        return public(out.orderBy("_depth", "id").limit(limit) if limit is not None else out)

    def _subgraph(self, start, depth, kind, limit) -> DataFrame:
        found = G.traverse(self.catalog.edges, self.nodes, start, depth, kind)
        return G.among(self.catalog.edges, found)

    def _ancestors(self, start, depth, kind, limit) -> DataFrame:
        out = G.traverse(G.reversed_edges(self.catalog.edges), self.nodes, start, depth, kind)
        return self._anchored(out, start, limit)

    def _descendants(self, start, depth, kind, limit) -> DataFrame:
        return self._anchored(G.traverse(self.catalog.edges, self.nodes, start, depth, kind), start, limit)

    def _anchored(self, found, start, limit) -> DataFrame:
        """The nearest ``limit`` nodes, the least ids of equally near ones."""
        out = public(found.withColumn("_query_anchor", F.col("id") == start))
        return out.orderBy("_depth", "id").limit(limit) if limit is not None else out

    def _path(self, a, b, most, kind) -> DataFrame:
        return G.shortest_path(visible_edges(self.catalog, kind), a, b, most)

    def _paths(self, a, b, most, kind) -> DataFrame:
        return G.all_paths(visible_edges(self.catalog, kind), a, b, most or 10, self.config.paths_cap)

    def _distance(self, a, b, most, kind) -> DataFrame:
        return G.distance(visible_edges(self.catalog, kind), a, b, most)

    def _weighted_path(self, a, b, most, kind) -> DataFrame:
        return G.weighted(visible_edges(self.catalog, kind), a, most).filter(F.col("id") == b).select("path", "cost")

    def _weighted_distance(self, a, b, most, kind) -> DataFrame:
        found = self._weighted_path(a, b, most, kind).agg(F.min("cost").alias("cost"))
        return found.select(F.coalesce("cost", F.lit(-1.0)).alias("distance"))

    def _common(self, a, b, kind) -> DataFrame:
        return public(self.nodes.join(G.common_neighbors(G.of_kind(self.catalog.edges, kind), a, b), "id", "left_semi"))

    def _match(self, steps, kinds, limit) -> DataFrame:
        nodes = self.nodes
        rules = [(name, None if rule is None else P.compile_rule(nodes, rule)) for name, rule in steps]
        out = G.match_chain(nodes, self.catalog.edges, rules, kinds)
        return out.orderBy(*out.columns).limit(limit) if limit is not None else out

    def _known(self, id: str) -> None:
        if not W.exists(self.nodes, id):
            raise NodeNotFound(id)

    def _recall(self, start, depth, limit, rule) -> DataFrame:
        self._known(start)
        nodes, s = self.nodes, self.catalog.session
        value = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in nodes.columns else F.lit(d)
        age = (F.lit(s.now_ms) - F.col("__updated_at__")) / R.DAY_MS if "__updated_at__" in nodes.columns else F.lit(0.0)
        weight = value("importance", 1.0) * value("__confidence__", 1.0) / (1 + F.coalesce(age, F.lit(0.0)))
        active = G.recall(visible_edges(self.catalog), start, depth, self.config.recall_decay).withColumnRenamed("score", "__spread__")
        found = nodes.join(active, "id").withColumn("_activation", F.col("__spread__") * weight)
        out = self._where(rule, found).filter("_activation > 0")
        out = out.orderBy(F.desc("_activation"), "id")
        return public(out.limit(limit) if limit is not None else out)

    def _similar(self, target, limit, rule) -> DataFrame:
        vectors = self.catalog.vectors
        if vectors is None:
            raise VectorNotFound("the catalog has no vectors")
        how, given = target
        if how == "node":
            row = vectors.filter(F.col("id") == given).first()
            if row is None:
                raise VectorNotFound(given)
            given = row.embedding
        elif how == "text":
            if self.embed is None:
                raise EmbedderRequired("SIMILAR TO a text needs an embedder")
            given = self.embed(given)
        return public(R.similar_to(self._where(rule).join(vectors.select("id", "embedding"), "id"), given, limit).drop("embedding"))

    def _lexical(self, text, limit, rule) -> DataFrame:
        if self.catalog.documents is None:
            raise QueryError("the catalog has no documents")
        found = R.bm25(self.catalog.documents, text, "id", "text", stemmed=self.config.stemming)
        return public(self._where(rule).join(found, "id").orderBy("_bm25_score", "id").limit(limit))

    def _what_if(self, id) -> DataFrame:
        self._known(id)
        return public(self.nodes.join(G.bfs(self.catalog.edges, id).select("id"), "id", "left_semi"))

    # writes

    def _now(self) -> int:
        return self.catalog.session.now_ms

    def _put(self, nodes: DataFrame) -> None:
        self.catalog = self.catalog.with_tables(nodes=nodes)

    def _bound(self, fields: dict[str, Any]) -> tuple[str, dict[str, Any]]:
        s, fields = self.catalog.session, dict(fields)
        kind = fields.pop("kind", "node")
        more = {"__context__": s.context, "__namespace__": s.namespace}
        return kind, fields | {k: v for k, v in more.items() if v is not None}

    def _create(self, id, fields, vector, document) -> None:
        kind, fields = self._bound(fields)
        self.kinds.check_node(kind, fields)
        spark = self.catalog.nodes.sparkSession
        if id is None:
            parts = {k: F.lit(v) for k, v in fields.items() if not k.startswith("__")}
            id = spark.range(1).select(auto_id(kind, **parts)).first()[0]
        self._made = id
        told = self.kinds.nodes.get(kind, {}).get("embed")
        text = document if document is not None else fields.get(told) if told else None
        if vector is None and text is not None and self.embed is not None:
            vector = [float(x) for x in self.embed(str(text))]
        self._put(W.create(self.catalog.nodes, id, kind, fields, self._now()))
        for name, value, column in (("vectors", vector, "embedding array<double>"), ("documents", document, "text string")):
            if value is not None:
                row = spark.createDataFrame([(id, value)], f"id string, {column}")
                held = getattr(self.catalog, name)
                self.catalog = self.catalog.with_tables(**{name: row if held is None else held.unionByName(row, allowMissingColumns=True)})
        self._sentences(id, kind, fields)

    def _sentences(self, id: str, kind: str, fields: dict[str, Any]) -> None:
        """A node for each sentence of the embed field, or of ``content``, with an edge from its own node."""
        text = fields.get(self.kinds.nodes.get(kind, {}).get("embed") or "content")
        if not self.config.sentence_nodes or kind in ("sentence", "entity") or not isinstance(text, str):
            return
        found = [(f"{id}:s{i}", s) for i, s in enumerate(split_sentences(text))]
        if not found:
            return
        spark, now = self.catalog.nodes.sparkSession, F.lit(self._now())
        more = {k: v for k, v in fields.items() if k in ("__event_at__", "__context__", "__namespace__")}
        rows = spark.createDataFrame(found, "id string, text string").withColumns(
            {"kind": F.lit("sentence"), "parent_node": F.lit(id), "__blob_state__": F.lit("warm"), "__created_at__": now, "__updated_at__": now, **{k: F.lit(v) for k, v in more.items()}}
        )
        self._put(W.widened(self.catalog.nodes, rows))
        self._link(rows.select(F.lit(id).alias("src"), F.col("id").alias("dst"), F.lit("has_sentence").alias("kind"), F.lit(1.0).alias("weight")))
        if self.embed is not None:
            held = self.catalog.vectors
            fresh = spark.createDataFrame([(i, [float(x) for x in self.embed(s)]) for i, s in found], "id string, embedding array<double>")
            self.catalog = self.catalog.with_tables(vectors=fresh if held is None else held.unionByName(fresh, allowMissingColumns=True))

    def _upsert(self, id, fields, vector, document) -> None:
        kind, fields = self._bound(fields)
        self.kinds.check_node(kind, fields)
        self._made = id
        self._put(W.upsert(self.catalog.nodes, id, kind, fields, self._now()))
        if vector is not None:
            held, spark = self.catalog.vectors, self.catalog.nodes.sparkSession
            row = spark.createDataFrame([(id, vector)], "id string, embedding array<double>")
            self.catalog = self.catalog.with_tables(vectors=row if held is None else held.filter(F.col("id") != id).unionByName(row, allowMissingColumns=True))

    def _update(self, id, fields) -> None:
        self._known(id)
        self._put(W.update_where(self.catalog.nodes, F.col("id") == id, fields, self._now()))

    def _update_nodes(self, rule, fields) -> None:
        nodes = self.catalog.nodes
        self._put(W.update_where(nodes, alive(nodes, self.catalog.session) & P.compile_rule(nodes, rule), fields, self._now()))

    def _delete(self, id) -> None:
        self._known(id)
        self.catalog = W.delete_nodes(self.catalog, self.catalog.nodes.filter(F.col("id") == id))

    _forget = _delete

    def _delete_nodes(self, rule) -> None:
        self.catalog = W.delete_nodes(self.catalog, self._where(rule))

    def _increment(self, id, field, by) -> None:
        self._known(id)
        self._put(W.increment(self.catalog.nodes, id, field, by))

    def _merge(self, source, target) -> None:
        nodes = self.catalog.nodes
        if "__updated_at__" not in nodes.columns:
            self._put(nodes.withColumn("__updated_at__", F.lit(None).cast("long")))
        self.catalog = W.merge_node(self.catalog, source, target, self._now())

    def _create_edge(self, src, dst, fields) -> None:
        fields = dict(fields)
        if fields.get("kind", "default") in self.kinds.edges:
            of = {r.id: r.kind for r in self.catalog.nodes.filter(F.col("id").isin(src, dst)).select("id", "kind").limit(2).collect()}
            self.kinds.check_edge(fields["kind"], of.get(src), of.get(dst))
        self.catalog = W.create_edge(self.catalog, src, dst, fields.pop("kind", "default"), fields.pop("weight", 1.0), fields)

    def _update_edge(self, src, dst, fields, kind) -> None:
        """Set weight and data of the edges between two nodes, of one kind if it is named."""
        edges, fields = self.catalog.edges, dict(fields)
        hit = (F.col("src") == src) & (F.col("dst") == dst)
        hit = hit if kind is None else hit & (F.col("kind") == kind)
        if "weight" in fields:
            edges = edges.withColumn("weight", F.when(hit, F.lit(float(fields.pop("weight")))).otherwise(F.col("weight")))
        if fields:
            if "data" not in edges.columns:
                edges = edges.withColumn("data", F.lit(None).cast("map<string,string>"))
            more = F.create_map(*[F.lit(x) for k, v in fields.items() for x in (k, None if v is None else str(v))]).cast("map<string,string>")
            held = F.map_filter(F.coalesce("data", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(list(fields)))
            edges = edges.withColumn("data", F.when(hit, F.map_concat(held, more)).otherwise(F.col("data")))
        self.catalog = self.catalog.with_tables(edges=edges)

    def _delete_edges(self, ends, kind) -> None:
        rule = F.lit(True)
        for c, v in ends.items():
            rule &= F.col(c) == v
        self.catalog = W.delete_edges(self.catalog, rule if kind is None else rule & (F.col("kind") == kind))

    def _assert(self, id, fields, confidence, source) -> None:
        kind, fields = self._bound(fields)
        self.kinds.check_node(kind, fields)
        self._put(W.assert_node(self.catalog.nodes, id, kind, fields, self._now(), confidence, source))

    def _retract(self, id, reason) -> None:
        self._put(W.retract(self.catalog.nodes, id, reason, self._now()))

    def _propagate(self, id, field, depth) -> None:
        self._known(id)
        value = self.catalog.nodes.filter(F.col("id") == id).select(F.col(field).cast("double")).first()[0]
        found = G.propagate(self.catalog.edges, id, value or 0.0, depth).select("id", F.col("value").alias(field))
        self._put(W.upsert_rows(self.catalog.nodes.withColumn(field, F.col(field).cast("double")), found.join(self.catalog.nodes.select("id"), "id", "left_semi")))

    def _session(self, **more) -> None:
        self.catalog = replace(self.catalog, session=replace(self.catalog.session, **more))

    def _bind_context(self, name) -> None:
        self._session(context=name, namespace=None)

    def _bind_namespace(self, name) -> None:
        self._session(namespace=name, context=None)

    def _discard_namespace(self, name) -> None:
        self._session(namespace=None)

    def _discard_context(self, name) -> None:
        nodes = self.catalog.nodes
        if "__context__" in nodes.columns:
            self.catalog = W.delete_nodes(self.catalog, nodes.filter(F.col("__context__") == name))
        self._session(context=None)

    # system statements

    def _sys_health(self) -> DataFrame:
        return M.health(self.catalog.nodes, self.catalog.edges)

    def _sys_expire(self, kind) -> None:
        if "__expires_at__" in self.catalog.nodes.columns:
            self.catalog = W.delete_nodes(self.catalog, M.expired(self.catalog.nodes, self._now(), kind))

    def _sys_retain(self) -> None:
        if "__blob_state__" in self.catalog.nodes.columns:
            self._put(M.retained(self.catalog.nodes, self._now(), self.config.archive_days, self.config.delete_days))

    def _sys_evict(self, limit) -> None:
        if "__updated_at__" in self.catalog.nodes.columns:
            gone = materialise(M.eviction_order(self.catalog.nodes, limit, tuple(self.config.protected_kinds)), "evicted")
            self.evicted += gone.count()
            self.catalog = W.delete_nodes(self.catalog, gone)

    def _sys_contradictions(self, rule, field, by) -> DataFrame:
        return M.contradictions(self._where(rule), field, by)

    def _vectors_where(self, rule) -> DataFrame:
        if self.catalog.vectors is None:
            raise VectorNotFound("the catalog has no vectors")
        return self.catalog.vectors.join(self._where(rule).select("id"), "id", "left_semi")

    def _sys_duplicates(self, rule, threshold) -> DataFrame:
        return R.duplicates(self._vectors_where(rule), threshold)

    def _sys_connect(self, rule, threshold) -> None:
        self._link(R.connect(self._vectors_where(rule), threshold).select("src", "dst", F.lit("similar_to").alias("kind"), "weight"))

    def _sys_snapshot(self, name) -> None:
        self.snapshots[name] = self.catalog

    def _sys_rollback(self, name) -> None:
        if name not in self.snapshots:
            raise QueryError(f"no such snapshot: {name}")
        self.catalog = self.snapshots[name]

    def _sys_snapshots(self) -> DataFrame:
        return self.catalog.nodes.sparkSession.createDataFrame([(n,) for n in sorted(self.snapshots)], "name string")

    def _sys_explain(self, statement: Statement) -> DataFrame:
        if statement.verb in ("remember", "answer"):
            return public(self._fused(**{k: v for k, v in statement.args.items() if k != "using"}))
        before = self.catalog
        out = getattr(self, f"_{statement.verb}")(**statement.args)
        if self.catalog is not before or out is None:
            self.catalog = before
            raise QueryError("SYS EXPLAIN takes a statement that reads")
        plan = out._jdf.queryExecution().toString()
        return self.catalog.nodes.sparkSession.createDataFrame([(plan,)], "plan string")
