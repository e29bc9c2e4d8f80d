from weftgraph.sources import notes, readers
from weftgraph.streaming import upserts


def test_readers(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>One <b>two</b></p><script>x</script>")
    (tmp_path / "t.csv").write_text('k,v\n1,"a,b"\n')
    assert readers.read(spark, str(tmp_path / "a.html")).first().text == "One two"
    assert readers.read(spark, str(tmp_path / "t.csv")).first().v == "a,b"
    assert readers.to_json(spark.createDataFrame([(1, None)], "a int, b string")).first().json == '{"a":1}'


def test_notes(spark, tmp_path):
    (tmp_path / "First Note.md").write_text("---\ntags: x\n---\n# Head\nsee [[Second]] and [[Nowhere]]\n")
    (tmp_path / "Second.md").write_text("no links")
    found = notes.notes(spark, str(tmp_path))
    assert {r.id: r.front for r in found.collect()} == {"note:first_note": "tags: x", "note:second": ""}
    edges = notes.links(found)
    assert [tuple(r) for r in edges.collect()] == [("note:first_note", "note:second", "links")]
    assert notes.backlinks(edges, "note:second").first().id == "note:first_note"


def test_streams(spark, tmp_path):
    schema = "id string, kind string, v long, at long"
    spark.createDataFrame([("a", "x", 1, 1), ("a", "x", 2, 2), ("b", "x", 3, 1)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = upserts.upsert_stream(stream, str(tmp_path / "out"), "at", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.id: r.v for r in spark.read.parquet(str(tmp_path / "out/v0")).collect()} == {"a": 2, "b": 3}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    counted = upserts.windowed_counts(events)
    assert sum(r.n for r in counted.collect()) == events.count()
