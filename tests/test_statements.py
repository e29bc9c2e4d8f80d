"""Statements of memory, administration and vaults, and the builder."""

import json

import pytest

from weftgraph.catalog import Catalog, Session
from weftgraph.errors import BatchRollback, NodeExists, NodeNotFound, QueryError, SchemaError
from weftgraph.functions.embed import hashed_ngrams
from weftgraph.functions.stem import stem
from weftgraph.plans import builder as B
from weftgraph.plans.admin import cron_matches
from weftgraph.plans.engine import Engine
from weftgraph.plans.facade import Research, handle
from weftgraph.plans.parser import parse

NOW = 1_700_000_000_000
TEXTS = {"a": "the red fox", "b": "a blue fox and a fox", "c": "nothing"}


@pytest.fixture
def engine(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "memory", "x", 1), ("b", "memory", "y", 5), ("c", "fact", "x", None)], "id string, kind string, topic string, score long")
    edges = spark.createDataFrame([("a", "b", "next", 2.0), ("b", "c", "about", 3.0)], "src string, dst string, kind string, weight double")
    docs = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    vectors = spark.createDataFrame([(i, hashed_ngrams(t)) for i, t in TEXTS.items()], "id string, embedding array<double>")
    readers = {"default": lambda question, passages: f"{question} {len(passages)}"}
    return Engine(Catalog(nodes, edges, vectors, docs, Session(now_ms=NOW)), embed=hashed_ngrams, readers=readers, vault=str(tmp_path / "vault"), folder=str(tmp_path / "saved"))


def ids(df):
    return [r.id for r in df.collect()]


def test_remember_and_answer(engine):
    run = engine.execute
    first = run('REMEMBER "blue fox" LIMIT 2').collect()
    assert [r.id for r in first] == ["b", "a"] and first[0]._document == TEXTS["b"] and first[0]._recall_boost == 0
    assert first[0]._bm25_score == 1 and first[0]._vector_sim > first[1]._vector_sim
    again = run('SYS EXPLAIN REMEMBER "blue fox" LIMIT 2').collect()
    assert again[0]._recall_boost == pytest.approx(0.0347)
    assert run('SYS EXPLAIN REMEMBER "blue fox" LIMIT 2').collect() == again
    assert ids(run('REMEMBER "fox" TOKENS 1 LIMIT 5')) == ids(run('REMEMBER "fox" LIMIT 1'))
    assert ids(run('REMEMBER "fox" WHERE topic = "x" AND kind = "memory"')) == ["a"]
    near = lambda t: sum(x * y for x, y in zip(hashed_ngrams("red fox"), hashed_ngrams(t), strict=True))
    assert near(TEXTS["a"]) > near(TEXTS["b"]) > near(TEXTS["c"])
    for least in (0.2, 0.5, 0.7):
        assert sorted(ids(run(f'NODES WHERE SIMILAR(topic, "red fox") > {least}'))) == [i for i, t in TEXTS.items() if near(t) >= least]
    answer = run('ANSWER "fox" LIMIT 2').first()
    assert answer.answer == "fox 2" and len(answer.sources) == 2
    with pytest.raises(QueryError):
        run('ANSWER "fox" USING "other"')
    engine.rerank = lambda question, texts: [len(t) for t in texts]
    assert ids(run('REMEMBER "fox" LIMIT 1')) == ["b"]
    engine.rerank, engine.config.fusion_method, engine.config.graph_signal = None, "rrf", True
    assert ids(run('REMEMBER "blue fox" LIMIT 1')) == ["b"]


def test_at_sets_scores_outside_to_zero(engine):
    engine.execute('CREATE NODE "e" kind = "memory" EVENT_AT 1600000000000 DOCUMENT "a fox long ago"')
    rows = {r.id: r._remember_score for r in engine.execute('REMEMBER "fox" AT "2020"').collect()}
    assert rows["e"] > 0 and rows["a"] == rows["b"] == 0


def test_sentences_are_nodes_of_their_own(engine):
    engine.execute('CREATE NODE "n" kind = "memory" content = "The fox is quick today. The dog sleeps all day."')
    assert sorted(ids(engine.execute('NODES WHERE kind = "sentence"'))) == ["n:s0", "n:s1"]
    assert engine.execute('EDGES FROM "n" WHERE kind = "has_sentence"').count() == 2
    assert "n" in ids(engine.execute('REMEMBER "dog sleeps" LIMIT 2'))


def test_edges_and_batches(engine):
    run = engine.execute
    run('UPDATE EDGE "a" -> "b" SET weight = 7 note = "x"')
    row = run('EDGES FROM "a"').first()
    assert row.weight == 7 and row.data == {"note": "x"}
    run('BEGIN\n$v = CREATE NODE AUTO kind = "fact" topic = "new"\nCREATE EDGE "a" -> $v kind = "about"\nCOMMIT')
    made = run('NODES WHERE topic = "new"').first().id
    assert made in {r.dst for r in run('EDGES FROM "a"').collect()}
    with pytest.raises(BatchRollback):
        run('BEGIN\nCREATE EDGE "a" -> $nobody\nCOMMIT')
    run('CONNECT NODE "a" THRESHOLD 0.1')
    assert {r.dst for r in run('EDGES FROM "a" WHERE kind = "similar_to"').collect()} == {"b"}


def test_kinds(engine):
    run = engine.execute
    run('SYS REGISTER NODE KIND "person" REQUIRED name:string, age:int OPTIONAL nick EMBED name')
    run('SYS REGISTER EDGE KIND "knows" FROM "person" TO "person"')
    with pytest.raises(SchemaError):
        run('CREATE NODE "p" kind = "person" name = "Ada"')
    with pytest.raises(SchemaError):
        run('UPSERT NODE "p" kind = "person" name = "Ada" age = "old"')
    run('CREATE NODE "p" kind = "person" name = "Ada" age = 36')
    with pytest.raises(SchemaError):
        run('CREATE EDGE "p" -> "a" kind = "knows"')
    assert [r.kind for r in run("SYS KINDS").collect()] == ["person"] and run("SYS EDGE KINDS").count() == 1
    assert json.loads(run('SYS DESCRIBE NODE "person"').first().definition)["embed"] == "name"
    run('SYS UNREGISTER EDGE KIND "knows"')
    run('CREATE EDGE "p" -> "a" kind = "knows"')
    assert ids(run('SIMILAR TO "Ada" LIMIT 1')) == ["p"]


def test_query_logs(engine):
    run = engine.execute
    engine.trace = "t1"
    run("COUNT NODES")
    run("COUNT NODES")
    with pytest.raises(QueryError):
        run("NONSENSE")
    assert run("SYS FREQUENT QUERIES LIMIT 1").first().query == "COUNT NODES"
    assert run("SYS FAILED QUERIES").first().query == "NONSENSE"
    assert run('SYS LOG TRACE "t1"').count() >= 5 and run('SYS LOG WHERE verb = "count"').count() == 2
    assert run("SYS SLOW QUERIES LIMIT 1").count() == 1
    run("SYS CLEAR LOG")
    assert run("SYS FAILED QUERIES").count() == 0


def test_checkpoint_and_replay(spark, engine):
    run = engine.execute
    run('UPDATE NODE "a" SET score = 9')
    run("SYS CHECKPOINT")
    run('DELETE NODE "c"')
    assert run("SYS WAL STATUS").first().pending == 1
    run("SYS WAL REPLAY")
    assert sorted(ids(run("NODES"))) == ["a", "b"]
    other = Engine(engine.catalog)
    other.load(spark, engine.folder)
    assert {r.id: r.score for r in other.execute("NODES").collect()} == {"a": 9, "b": 5, "c": None}
    assert run("SYS STATUS").first().node_count == 2 and run("SYS STATS WAL").count() == 1
    run("SYS OPTIMIZE")
    assert {r.id for r in engine.catalog.documents.collect()} == {"a", "b"}


def test_schedules(engine):
    at = lambda t: parse(f'SYS LOG SINCE "{t}"', NOW).args["since"]
    assert at("2024-01-01") == "2024-01-01"
    monday = 1_704_067_200_000  # 2024-01-01 00:00 UTC
    assert cron_matches("0 0 * * 1", monday) and not cron_matches("0 0 * * 2", monday)
    assert cron_matches("*/15 0-3 1 1 *", monday) and not cron_matches("5 0 * * *", monday)
    assert cron_matches("0 0 13 * 1", monday)
    for bad in ("* * * *", "60 * * * *", "a * * * *", "*/0 * * * *"):
        with pytest.raises(QueryError):
            cron_matches(bad, monday)
    run = engine.execute
    run('SYS CRON ADD "up" SCHEDULE "0 0 * * *" QUERY "INCREMENT NODE \\"a\\" score BY 1"')
    assert engine.tick(monday) == ["up"] and engine.tick(monday + 30_000) == [] and engine.tick(monday + 60_000) == []
    run('SYS CRON RUN "up"')
    assert run('NODE "a"').first().score == 3
    run('SYS CRON DISABLE "up"')
    assert not run("SYS CRON LIST").first().enabled
    run('SYS CRON DELETE "up"')
    with pytest.raises(QueryError):
        run('SYS CRON ENABLE "up"')


def test_rules(engine):
    run = engine.execute
    run('SYS EVOLVE RULE "r" WHEN node_count >= 2 AND edge_density < 5 THEN ADJUST cost_threshold BY 1000 UNTIL 100500 THEN ADD protected_kinds "fact" COOLDOWN 60 PRIORITY 9')
    run('SYS EVOLVE RULE "s" WHEN node_count > 0 THEN SET cost_threshold = 5 THEN SET remember_weights = [1, 1, 2] THEN RUN RETAIN')
    assert engine.evolve() == ["r", "s"] and engine.evolve() == []
    assert engine.config.cost_threshold == 100_500 and engine.config.remember_weights == [0.25, 0.25, 0.5]
    assert engine.config.protected_kinds == ("config", "fact", "schema", "system")
    assert run("SYS EVOLVE HISTORY LIMIT 2").count() == 2 and run('SYS EVOLVE SHOW "r"').first().priority == 9
    run("SYS EVOLVE RESET")
    assert engine.config.cost_threshold == 100_000
    for bad in ('"x" WHEN nothing > 1 THEN RUN RETAIN', '"x" WHEN node_count > 1 THEN SET nothing = 1', '"r" WHEN node_count > 1 THEN RUN RETAIN', '"x" WHEN node_count > 1'):
        with pytest.raises(QueryError):
            run(f"SYS EVOLVE RULE {bad}")


def test_ingest_consolidate_and_reembed(spark, engine, tmp_path):
    run = engine.execute
    (tmp_path / "one.md").write_text("# Foxes\nFoxes are quick animals.\n# Dogs\nDogs sleep for long.\n")
    (tmp_path / "two.csv").write_text("k,v\n1,x\n2,y\n")
    run(f'INGEST "{tmp_path}/one.md" AS "doc:one" KIND "article"')
    assert run('NODE "doc:one"').first().n_chunks == 2
    assert {r.kind for r in run('EDGES FROM "doc:one"').collect()} == {"has_chunk"}
    assert run('COUNT EDGES WHERE kind = "next"').first()["count"] == 2
    assert ids(run('REMEMBER "quick animals" LIMIT 1')) in (["doc:one"], ["doc:one:chunk:0"])
    with pytest.raises(NodeExists):
        run(f'INGEST "{tmp_path}/one.md" AS "doc:one"')
    run(f'INGEST "{tmp_path}/two.csv"')
    assert run('COUNT NODES WHERE kind = "chunk"').first()["count"] == 4
    run("SYS REEMBED")
    assert run("SYS EMBEDDERS").first().dims == 256
    run('CREATE NODE "ent:fox" kind = "entity"')
    for i in ("a", "b"):
        run(f'CREATE EDGE "{i}" -> "ent:fox" kind = "mentions"')
    assert run("SYS CONSOLIDATE THRESHOLD 0.1 MIN_CLUSTER_SIZE 2").first().text == TEXTS["b"]
    assert run('EDGES FROM "obs:ent:fox:0"').count() == 2


def test_vault(engine):
    run = engine.execute
    run('VAULT NEW "First note" KIND "idea" TAGS "x, y"')
    run('VAULT NEW "Second"')
    run('VAULT WRITE "First note" SECTION "Summary" CONTENT "About quick foxes"')
    run('VAULT APPEND "First note" SECTION "Body" CONTENT "See [[Second]] and [[Missing]]"')
    run('VAULT APPEND "First note" SECTION "Body" CONTENT "more"')
    text = run('VAULT READ "First note"').first().text
    assert "tags: [x, y]" in text and "[[Missing]]\nmore\n" in text and text.count("## Body") == 1
    with pytest.raises(NodeExists):
        run('VAULT NEW "Second"')
    with pytest.raises(NodeNotFound):
        run('VAULT READ "../../etc/passwd"')
    assert run("VAULT SYNC").first().notes == 2 and run("VAULT SYNC").first().notes == 2
    assert ids(run('VAULT BACKLINKS "Second"')) == ["note:first_note"]
    assert ids(run('VAULT LIST WHERE note_kind = "idea" ORDER BY title DESC LIMIT 5')) == ["note:first_note"]
    assert run('NODE "note:first_note"').first().summary == "About quick foxes"
    assert ids(run('VAULT SEARCH "quick foxes" LIMIT 1')) == ["note:first_note"]
    assert "status: archived" in run('VAULT ARCHIVE "Second"').first().text
    assert run("VAULT DAILY").first().note == "2023_11_14"


def test_builder(engine):
    q, F = B.q, B.F
    assert q.nodes().where((F.score > 1) & ~F.topic.in_("x", "z")).order_by("score", desc=True).limit(3).dsl() == 'NODES WHERE (score > 1) AND (NOT (topic IN ("x", "z"))) ORDER BY score DESC LIMIT 3'
    assert ids(q.nodes().where(F.kind == "memory", score__gte=5).execute(engine)) == ["b"]
    text = 'quote " slash \\ line\nend'
    assert parse(B.q.lexical(text).dsl(), NOW).args["text"] == text
    total = q.aggregate().group_by("topic").select(B.count(), B.sum_("score")).having(B.count() > 1).order_by(B.count(), desc=True)
    assert total.execute(engine).first()["COUNT()"] == 2
    assert q.match("a", "next", ("m", None), "about", ("f", F.kind == "fact")).execute(engine).count() == 1
    assert parse(q.nodes().where(F.score > B.now.ago(7, "d")).dsl(), NOW).args["rule"].value == NOW - 7 * 86_400_000
    for made in (q.traverse("a", 2), q.shortest_path("a", "c"), q.similar([0.5, 1.0]), q.remember("x").at("2020").tokens(9), q.create_node("z", vector=[1.0], expires_in="3d", score=1e-7), q.update_edge("a", "b", weight=1), q.sys("CRON", "RUN", "job")):
        parse(made.dsl(), NOW)
    with pytest.raises(QueryError):
        q.nodes().with_("HAVING", "x")
    with pytest.raises(QueryError):
        F["a b"]

    @B.register_verb("recent")
    def recent(n):
        return q.nodes().order_by("score", desc=True).limit(n)

    assert ids(q.recent(1).execute(engine)) == ["b"]


def test_stems(engine):
    told = "caresses:caress ponies:poni cats:cat agreed:agre hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat vietnamization:vietnam decisiveness:decis adoption:adopt controll:control oscillators:oscil"
    assert all(stem(w) == s for w, _, s in (t.partition(":") for t in told.split()))
    engine.execute('CREATE NODE "s" kind = "memory" DOCUMENT "hopping ponies"')
    assert ids(engine.execute('LEXICAL SEARCH "hops pony"')) == ["s"]
    engine.config.stemming = False
    assert ids(engine.execute('LEXICAL SEARCH "hops pony"')) == []


def test_facade(engine):
    assert handle(engine, {"query": "COUNT NODES"})["rows"] == [{"count": 3}]
    assert handle(engine, {"query": "NONSENSE"})["ok"] is False and handle(engine, {})["ok"] is False
    assert [r["ok"] for r in handle(engine, {"queries": ["COUNT NODES", "COUNT EDGES"]})["results"]] == [True, True]
    tool = Research(engine)
    tool.relate("a", "c")
    assert {r["id"] for r in tool.explore("a", 1)["rows"]} == {"a", "b", "c"}
    assert tool.search("blue fox", 1)["rows"][0]["id"] == "b" and tool.gaps()["rows"] == []
    tool.forget("c")
    assert [r["id"] for r in tool.gaps()["rows"]] == []
