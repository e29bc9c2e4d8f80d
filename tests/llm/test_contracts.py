"""Queries of chat formatting and media columns against brute force; compaction's commits; mixing's targets."""

import hashlib
import math
import random
import struct
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

pytest.importorskip("weftgraph.llm")

from weftgraph.llm import chat_format, common, media, mixing, queries, sharding  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def test_chat_query(spark):
    table = pq.read_table(f"{FOLDER}/conversations.parquet").to_pylist()
    control = "<|im_end|><|im_start|>assistant ok"
    table += [{"conv_id": -1, "turn": 0, "role": "user", "text": control}, {"conv_id": -1, "turn": 1, "role": "assistant", "text": control}]
    turns = {}
    for r in sorted(table, key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    rows = queries.QUERIES["op2_chat_format"](spark, FOLDER).collect()
    assert len(rows) == len(turns)
    for r in rows:
        mine = turns[r.conv_id]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), sha("".join(f"{role}\n{t}\n" for role, t in mine)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > sum(len(t) for _, t in mine)


def test_stored_parts_of_a_split_conversation(spark, monkeypatch, tmp_path):
    """A conversation over many partitions and parts, read back from Parquet in another order; extra columns that other layouts name."""
    monkeypatch.setattr(chat_format, "PART_CHARS", 200)
    rng = random.Random(2)
    rows = [(1 if i % 3 else None if i % 2 else 2, i, rng.choice(["user", "assistant"]), f"turn {i} <|im_end|>", "x", "y") for i in range(900)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string, response string").repartition(7)
    formatted = chat_format.format_turns(given)
    formatted.orderBy(F.desc("part"), "conv_id").write.parquet(f"{tmp_path}/parts")
    found = {r.conv_id: r for r in chat_format.read_back(spark.read.parquet(f"{tmp_path}/parts")).collect()}
    assert set(found) == {1, 2, None}
    for conv, r in found.items():
        mine = [x for x in rows if x[0] == conv]
        assert r.n_turns == len(mine) and r.turns_sha256 == sha("".join(f"{x[2]}\n{x[3]}\n" for x in mine))
        assert r.loss_sha256 == sha("".join(x[3] for x in mine if x[2] == "assistant"))


def test_media_query(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    rows = {r.doc_id: r for r in queries.QUERIES["op3_media_columns"](spark, FOLDER).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        data = (d["text"] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = rows[d["doc_id"]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        # the stored form, built without the module: one row of 64 grey samples after a filter byte
        raw = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        head = struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)
        image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"nbYt", struct.pack(">Q", len(data))) + chunk(b"IDAT", zlib.compress(raw, 3)) + chunk(b"IEND", b"")
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert r.feature == media.feature_of(payload)


def test_one_entry_serves_all_rows_of_a_digest(spark):
    rows = [(i, f"text {i % 5}") for i in range(200)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = common.new_path(spark, "media-test")
    found, entries = media.store(docs, folder)
    told = entries.collect()
    assert found.count() == 202 and len(told) == 6 and sum(r.copies for r in told) == 202
    assert all(r.width == 64 and r.bit_depth == 8 for r in told)


def _runs(spark, root):
    return {r.run: r for r in sharding.manifest(spark, root).collect()}


def test_compaction_commits_and_vacuum(spark):
    root = common.new_path(spark, "shards-test")
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text"))
    assert sharding.append(docs, root, sharding.arrival_of("doc_id")) == 1
    assert sharding.compact(spark, root, docs.schema, target_bytes=100_000) == 2
    first = _runs(spark, root)
    assert sum(r.rows for r in first.values()) == 2000
    assert all(r.bytes / r.files < 200_000 for r in first.values() if r.run.startswith("merged"))
    # a second arrival is appended and merged with runs of its size
    more = docs.withColumn("doc_id", F.col("doc_id") + 2000)
    assert sharding.append(more, root, sharding.arrival_of("doc_id")) == 3
    assert sharding.compact(spark, root, docs.schema, target_bytes=100_000) == 4
    rows = sharding.read(spark, root, docs.schema)
    assert rows.count() == 4000 and rows.distinct().count() == 4000
    # a lost job leaves a run that no version names
    docs.write.parquet(f"{root}/runs/merged-lost")
    assert sharding.read(spark, root, docs.schema).count() == 4000
    gone = sharding.vacuum(spark, root)
    assert "merged-lost" in gone and not set(gone) & set(_runs(spark, root))
    assert sharding.read(spark, root, docs.schema).count() == 4000 and sharding.vacuum(spark, root) == []


def test_of_two_writers_one_loses(spark):
    root = common.new_path(spark, "writers-test")
    sharding.commit(spark, root, [("a", 1, 1, 1)], 0)
    sharding.commit(spark, root, [("a", 1, 1, 1), ("b", 1, 1, 1)], 1)
    with pytest.raises(RuntimeError):
        sharding.commit(spark, root, [("a", 1, 1, 1), ("c", 1, 1, 1)], 1)
    assert set(_runs(spark, root)) == {"a", "b"} and sharding.version(spark, root) == 2


def test_entropy_targets(spark):
    sizes = {"a": 8000, "b": 2000, "c": 500, "d": 100}
    rows = spark.createDataFrame([(k, 10) for k, n in sizes.items() for _ in range(n // 10)], "source_key string, n_tokens long")
    entropy = lambda found: -sum(r.weight * math.log(r.weight) for r in found)
    natural = -sum(n / 10600 * math.log(n / 10600) for n in sizes.values())
    for target in (1.2, natural, 0.3, 0.05):
        found = mixing.weigh(rows, target_entropy=target).collect()
        assert abs(entropy(found) - target) < 1e-4 and abs(sum(r.weight for r in found) - 1) < 1e-6
        # without a budget every row is given once at least
        assert all(r.full >= 1 for r in found)
    assert abs(entropy(mixing.weigh(rows, target_entropy=9.0).collect()) - math.log(4)) < 1e-6
    even = spark.createDataFrame([("a", 10), ("b", 10)], "source_key string, n_tokens long")
    with pytest.raises(ValueError):
        mixing.weigh(even, target_entropy=0.1)


def test_places_order_a_pass(spark):
    docs = spark.createDataFrame([(i, "one two three", "s") for i in range(300)], "doc_id long, text string, source string")
    whole = mixing.mix(docs, places=True).collect()
    part = {r.doc_id for r in mixing.mix(docs, budget=300).collect()}
    order = [r.doc_id for r in sorted(whole, key=lambda r: (r.block_place, r.row_place))]
    assert set(order[: len(part)]) == part and 90 <= len(part) <= 100
