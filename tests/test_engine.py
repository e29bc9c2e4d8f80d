import pytest

from weftgraph.catalog import Catalog, Session
from weftgraph.errors import BatchRollback, EmbedderRequired, NodeNotFound, QueryError
from weftgraph.plans.engine import Engine

NOW = 1_700_000_000_000


@pytest.fixture
def engine(spark):
    nodes = spark.createDataFrame([("a", "memory", "x", 1), ("b", "memory", "y", 5), ("c", "fact", "x", None)], "id string, kind string, topic string, score long")
    edges = spark.createDataFrame([("a", "b", "next", 2.0), ("b", "c", "about", 3.0)], "src string, dst string, kind string, weight double")
    docs = spark.createDataFrame([("a", "the red fox"), ("b", "a blue fox fox"), ("c", "nothing")], "id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    return Engine(Catalog(nodes, edges, vectors, docs, Session(now_ms=NOW)))


def ids(df):
    return [r.id for r in df.collect()]


def test_reads(engine):
    run = engine.execute
    assert ids(run('NODES WHERE kind = "memory" AND score > 1 ORDER BY score DESC LIMIT 10')) == ["b"]
    assert ids(run("NODES ORDER BY score DESC")) == ["b", "a", "c"]
    assert ids(run("NODES WHERE INDEGREE > 0 ORDER BY id LIMIT 5")) == ["b", "c"]
    assert run('COUNT EDGES WHERE kind = "next"').first()["count"] == 1
    assert run("AGGREGATE NODES GROUP BY topic SELECT COUNT(), SUM(score) HAVING COUNT() > 1 ORDER BY COUNT() DESC").first().asDict() == {"topic": "x", "COUNT()": 2, "SUM(score)": 1.0}
    assert sorted(ids(run('TRAVERSE FROM "a" DEPTH 2'))) == ["a", "b", "c"]
    assert run('SHORTEST PATH FROM "a" TO "c"').first().path == ["a", "b", "c"]
    assert run('DISTANCE FROM "c" TO "a" MAX_DEPTH 3').first().distance == -1
    assert run('WEIGHTED DISTANCE FROM "a" TO "c"').first().distance == 5.0
    assert [tuple(r) for r in run('MATCH ("a") -[kind = "next"]-> (m) -[kind = "about"]-> (f WHERE kind = "fact")').collect()] == [("a", "b", "c")]
    assert ids(run('SIMILAR TO NODE "a" LIMIT 2')) == ["a", "b"]
    assert ids(run("SIMILAR TO [0, 1] LIMIT 1")) == ["c"]
    assert sorted(ids(run('LEXICAL SEARCH "fox blue"'))) == ["a", "b"]
    assert ids(run('RECALL FROM "a" DEPTH 1')) == ["b"]
    assert sorted(ids(run('WHAT IF RETRACT "b"'))) == ["b", "c"]


def test_errors(engine):
    with pytest.raises(QueryError):
        engine.execute("SELECT 1")
    with pytest.raises(QueryError):
        engine.execute('TRAVERSE FROM "a" DEPTH 2 WHERE score > 1')
    with pytest.raises(NodeNotFound):
        engine.execute('RECALL FROM "z" DEPTH 1')
    with pytest.raises(EmbedderRequired):
        engine.execute('SIMILAR TO "text"')


def test_writes_replay_and_roll_back(engine):
    start = engine.catalog
    run = engine.execute
    run('CREATE NODE "d" kind = "fact" topic = "z" score = 7 EXPIRES IN 1h')
    run('CREATE EDGE "c" -> "d" kind = "about" weight = 2')
    run('UPDATE NODES WHERE kind = "fact" SET topic = "w"')
    run('RETRACT "a" REASON "old"')
    run('INCREMENT NODE "b" score BY 2')
    state = sorted((r.id, r.topic, r.score) for r in run("NODES").collect())
    assert state == [("b", "y", 7), ("c", "w", None), ("d", "w", 7)]
    with pytest.raises(BatchRollback):
        run('BEGIN\nDELETE NODE "b"\nDELETE NODE "zzz"\nCOMMIT')
    assert sorted((r.id, r.topic, r.score) for r in run("NODES").collect()) == state
    again = Engine(start)
    again.replay(engine.log)
    assert sorted((r.id, r.topic, r.score) for r in again.execute("NODES").collect()) == state
    run('SYS SNAPSHOT "s"')
    run('MERGE NODE "d" INTO "c"')
    assert {r.id: r.score for r in run("NODES").collect()} == {"b": 7, "c": 7}
    run('SYS ROLLBACK TO "s"')
    assert len(ids(run("NODES"))) == 3
    run('BIND CONTEXT "t"')
    run('CREATE NODE "e" kind = "fact"')
    assert ids(run("NODES")) == ["e"]
    run('DISCARD CONTEXT "t"')
    assert len(ids(run("NODES"))) == 3
