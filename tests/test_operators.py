from itertools import pairwise

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.catalog import Catalog, Session, visible_edges, visible_nodes
from weftgraph.errors import NodeExists, NodeNotFound
from weftgraph.functions import temporal, text
from weftgraph.operators import graph as G
from weftgraph.operators import maintenance as M
from weftgraph.operators import predicates as P
from weftgraph.operators import retrieval as R
from weftgraph.operators import writes as W

NOW = 1_700_000_000_000


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", "road", 10.0), ("a", "c", "road", 1.0), ("c", "b", "road", 1.0), ("b", "d", "rail", 2.0), ("d", "a", "rail", 1.0)]
    return spark.createDataFrame(rows, "src string, dst string, kind string, weight double")


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("a", "x", 1, "aa"), ("b", "x", None, "ab\nc"), ("c", "y", 3, None), ("d", "y", 4, "a%b")]
    return spark.createDataFrame(rows, "id string, kind string, n int, s string")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_walks(edges):
    assert {r.id: r.depth for r in G.bfs(edges, "a", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert G.shortest_path(edges, "a", "d").first().path == ["a", "b", "d"]
    assert G.shortest_path(edges, "a", "a").first().hops == 0
    assert G.distance(edges, "d", "d").first().distance == 0
    assert G.distance(edges, "a", "nowhere").first().distance == -1
    assert [r.path for r in G.all_paths(edges, "a", "b", 3).collect()] == [["a", "b"], ["a", "c", "b"]]


def test_weights(edges):
    best = {r.id: (r.cost, r.path) for r in G.weighted(edges, "a").collect()}
    assert best["b"] == (2.0, ["a", "c", "b"]) and best["a"] == (0.0, ["a"])
    assert "d" not in {r.id for r in G.weighted(edges, "a", 3.0).collect()}


def test_recall_counts_both_ways(edges):
    scores = {r.id: r.score for r in G.recall(edges, "a", 1, 0.5).collect()}
    assert scores == {"b": 5.0, "c": 0.5, "d": 0.5}


def test_predicates(nodes):
    keep = lambda rule: ids(nodes.filter(P.compile_rule(nodes, rule)))
    assert keep(P.Cmp("n", "!=", 1)) == ["c", "d"]
    assert keep(P.Not(P.Cmp("n", "=", 1))) == ["c", "d"]
    assert keep(P.Cmp("n", "=", None)) == ["b"]
    assert keep(P.Cmp("n", "=", "1")) == []
    assert keep(P.Like("s", "a%")) == ["a", "d"]
    assert keep(P.Like("s", "a%b")) == ["d"]
    assert keep(P.Not(P.Contains("s", "%"))) == ["a", "b", "c"]
    assert keep(P.Cmp("missing", "!=", 1)) == []
    assert keep(P.In("n", (3, None, "x"))) == ["c"]


def test_order_of_nulls(nodes):
    assert [r.id for r in nodes.orderBy(*P.order_by(nodes, "n", True)).collect()][-1] == "b"
    assert [r.id for r in nodes.orderBy(*P.order_by(nodes, "s", True)).collect()][0] == "c"


def test_visibility(spark, edges, nodes):
    catalog = Catalog(W.retract(nodes, "b", "wrong", NOW), edges, session=Session(now_ms=NOW))
    assert ids(visible_nodes(catalog)) == ["a", "c", "d"]
    assert sorted((r.src, r.dst) for r in visible_edges(catalog).collect()) == [("a", "c"), ("d", "a")]
    again = W.assert_node(catalog.nodes, "b", "x", {"n": 2.5}, NOW, confidence=0.9)
    assert ids(visible_nodes(catalog.with_tables(nodes=again))) == ["a", "b", "c", "d"]


def test_writes(spark, edges, nodes):
    with pytest.raises(NodeExists):
        W.create(nodes, "a", "x", {}, NOW)
    with pytest.raises(NodeNotFound):
        W.retract(nodes, "z", None, NOW)
    made = W.create(nodes, "e", "x", {"n": 1.5, "more": "t"}, NOW)
    assert {r.id: r.n for r in made.collect()} == {"a": 1.0, "b": None, "c": 3.0, "d": 4.0, "e": 1.5}
    merged = W.merge_node(Catalog(nodes, edges), "c", "b", NOW) if "__updated_at__" in nodes.columns else W.merge_node(Catalog(W.update_where(nodes, F.lit(False), {}, NOW), edges), "c", "b", NOW)
    assert {r.id: r.n for r in merged.nodes.collect()} == {"a": 1, "b": 3, "d": 4}
    assert ("b", "b") in {(r.src, r.dst) for r in merged.edges.collect()}
    gone = W.delete_nodes(Catalog(nodes, edges), nodes.filter("id = 'a'"))
    assert sorted((r.src, r.dst) for r in gone.edges.collect()) == [("b", "d"), ("c", "b")]


def test_duplicates_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    vectors = np.vstack([base, base + 0.05 * rng.standard_normal(base.shape)])
    rows = [(f"{i:03d}", v.tolist()) for i, v in enumerate(vectors)]
    found = {(r.a, r.b) for r in R.near_pairs(spark.createDataFrame(rows, "id string, embedding array<double>"), 0.9).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = {(f"{i:03d}", f"{j:03d}") for i in range(80) for j in range(i + 1, 80) if unit[i] @ unit[j] >= 0.9}
    assert found == want


def test_equal_vectors_match_sql(spark, tmp_path):
    import duckdb
    import numpy as np

    from weftgraph.plans.catalogue import ORACLES, QUERIES

    rng = np.random.default_rng(2)
    base = [np.eye(8)[i] for i in range(4)]
    near = [np.round(v + 0.05 * rng.standard_normal(8), 3) for v in base]
    vectors = [base[i] for i, n in enumerate((14, 3, 2, 1)) for _ in range(n)] + [v for v in near for _ in range(3)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("duplicates", "connect_topk"):
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(c.sql(ORACLES[name]).select(*columns).fetchall()), name


def test_consolidate(spark):
    rows = [("e", "1", [1.0, 0.0]), ("e", "2", [0.9, 0.1]), ("e", "3", [0.0, 1.0]), ("f", "1", [1.0, 0.0])]
    out = M.consolidate(spark.createDataFrame(rows, "entity string, id string, embedding array<double>")).collect()
    assert [(r.entity, r.members) for r in out] == [("e", ["1", "2"])]


@given(st.text(max_size=200))
def test_sentences_keep_words(t):
    assert "".join("".join(text.split_sentences(t)).split()) == "".join(t.split())


def test_chunks_and_dates():
    assert [h for h, _ in text.chunk_by_heading("# A\nx\n## B\ny")] == ["A", "B"]
    assert all(len(c) <= 10 for c in text.chunk_by_paragraph("a b c d\n\n" * 5, 10))
    day = temporal.parse_date("2024-02-03", NOW)
    assert temporal.parse_date("3 February 2024", NOW) == temporal.parse_date("February 3, 2024", NOW) == day
    assert temporal.parse_date("2 days ago", NOW) == NOW - 2 * temporal.DAY_MS
    assert all(a < b for a, b in pairwise(temporal.extract_dates("2023-01-02 and 2024-01-02", NOW)))


def test_rrf_ranks_as_by_hand(spark):
    rows = [(i, [None, 0.0, -1.0, 2.0, 2.0, float(i)][i % 6], float(i % 7)) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, a double, b double")

    def places(values):
        good = sorted((v for v in values if v is not None and v > 0), reverse=True)
        return [good.index(v) + 1 + (good.count(v) - 1) / 2 if v is not None and v > 0 else len(values) for v in values]

    want = {i: 1 / (60 + x) + 1 / (60 + y) for i, x, y in zip(range(300), places([r[1] for r in rows]), places([r[2] for r in rows]), strict=True)}
    found = {r.id: r.rrf for r in R.rrf(table, ["a", "b"]).collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-12 for i in want)
    assert not R.rrf(table.limit(0), ["a"]).collect()
