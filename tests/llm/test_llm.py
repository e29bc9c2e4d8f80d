"""Edge cases of every operator, and brute-force versions of those that SQL can't say."""

import hashlib
import itertools
import random
import string
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("weftgraph.llm")

import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from weftgraph.llm import chat_format, exact_dedup, html_extract, language_id, media, mixing, order_minhash, queries, secrets, sentencepiece_bpe, sharding  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__block` int, digest string, bucket string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows_of(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(n)]
    for t in base[: n // 3]:
        w = t.split()
        w[rng.randrange(len(w))] = word()
        base.append(" ".join(w))
        base.append(t.upper())
    odd = [None, "", "  ", "\n\n", "x", "x", "😀 ✓", "a" * 30_000, "the cat " * 5_000, "ſecret İK"]
    out = [(i, t) for i, t in enumerate(base + odd)]
    return [*out, (None, "no id"), (None, None), out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if (i or 0) % 7 == 0 else "en", None if (i or 0) % 11 == 0 else "s0" if (i or 0) % 3 else "s1", None, 1, "d", "b") for i, t in rows_of()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_all_take_empty_tables(spark, none):
    assert exact_dedup.classify(none).count() == 0
    assert order_minhash.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert media.media_columns(none).count() == 0
    assert secrets.scan_documents(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert language_id.identify(none).count() == 0
    assert sentencepiece_bpe.encode(none, MODEL).count() == 0
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_turns(empty)).count() == 0


def test_exact_dedup(docs):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    groups = {}
    for i, t in rows_of():
        groups.setdefault((t or "").translate(lower), []).append(i)
    found = exact_dedup.classify(docs).collect()
    assert len(found) == len(rows_of())
    want = {hashlib.sha256(k.encode()).hexdigest(): (max((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in found)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns


def test_deduplicate_keeps_one_row_of_each_text(spark):
    rows = [(1, "Aa", "a"), (2, "aA", "b"), (3, "x", "c"), (3, "y", "d"), (4, "Y", "e"), (None, "z", "f"), (None, "Z", "g"), (None, "q", "h"), (5, "q", "i")]
    rows += [(6, "r", "j"), (6, "r", "j"), (6, "r", None), (7, None, "k"), (8, "", "l"), (8, "", "l"), (9, "é", "m"), (10, "É", "n")]
    rows += [(11, "often", str(i)) for i in range(400)] + [(12, "w" * 200_000, "o"), (13, "W" * 200_000, "p")]
    table = spark.createDataFrame(rows, "doc_id long, text string, __digest string")
    kept = exact_dedup.deduplicate(table)
    assert kept.columns == table.columns
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    want = {}
    for i, t, _ in rows:
        t = (t or "").translate(lower)
        want[t] = max(want.get(t, -1), -1 if i is None else i)
    found = kept.collect()
    assert sorted(((r.text or "").translate(lower), -1 if r.doc_id is None else r.doc_id) for r in found) == sorted(want.items())
    assert {tuple(r) for r in found} <= set(rows)
    assert not exact_dedup.deduplicate(table.limit(0)).collect()


def test_sentencepiece_and_media(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in sentencepiece_bpe.encode(docs, MODEL, with_ids=True).collect():
        assert r.ids[-1] == library.eos_id() and r.n_tokens == len(r.ids)
    want = {i: t or "" for i, t in rows_of() if i is not None}
    for r in sentencepiece_bpe.encode(docs.filter("doc_id is not null"), MODEL, with_ids=True).collect():
        assert r.ids == library.encode(want[r.doc_id], add_eos=True) and r.decoded == library.decode(r.ids)
    for r in media.media_columns(docs.filter("doc_id is not null")).collect():
        payload, n = media.payload_of(want[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.feature


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab ▁\n\t.é日😀\x00<>")), max_size=40))
def test_encoder_is_the_library(text):
    encoder = sentencepiece_bpe.encoder_of(MODEL)
    assert encoder.encode(text) == encoder.library.encode(text, add_eos=True)


@given(st.text(alphabet=st.sampled_from(list("<|\\>im_endstar\n ")), max_size=30), st.text(alphabet="<|\\n\n", max_size=6))
def test_chat_escapes_are_reversible(text, role):
    piece, a, b = chat_format.format_turn(role, text)
    assert chat_format.read_turns(piece) == [(role, text)]
    assert chat_format.unescape(piece[a:b]) == text


def test_chat_layouts(spark):
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}',
        '{"instruction": "q", "output": "a"}',
        '{"data": {"prompt": "q", "response": "a"}}',
    ]
    bad = [None, "", "{", "[1]", '{"other": 1}']
    rows = spark.createDataFrame(list(enumerate(records + bad)), "conv_id long, body string")
    for r in chat_format.format_records(rows, "conv_id", "body").collect():
        assert chat_format.read_turns(r.formatted) == ([("user", "q"), ("assistant", "a")] if r.conv_id < len(records) else [])


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=7), st.randoms())
def test_minimum_cut_is_the_best_labelling(scores, rng):
    ties = [(i, j, rng.random() * 3) for i in range(len(scores)) for j in range(i) if rng.random() < 0.6]
    cost = lambda lab: sum(max(0, -s) if x else max(0, s) for s, x in zip(scores, lab, strict=True)) + sum(w for i, j, w in ties if lab[i] != lab[j])
    best = min(map(cost, itertools.product([False, True], repeat=len(scores))))
    assert abs(cost(html_extract.label(scores, ties)) - best) < 1e-6


def test_language(spark):
    words = {"en": "the of and that with from this".split(), "fr": "le la des que dans pour avec".split()}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(200) for lang in [("en", "fr")[i % 2]]]
    rows += [(900, None, "en"), (901, "", None), (902, "12 34 !", "fr"), (903, "x", None)]
    found = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows[:200])
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (900, 901, 902))
    assert found[0].held_out == (zlib.crc32(b"0") % 4 == 2)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_mixing(docs):
    found = mixing.mix(docs).collect()
    assert {r.doc_id for r in found} == {i for i, _ in rows_of()}
    assert max(r.epoch for r in found) <= 2
    small = mixing.mix(docs, budget=500).collect()
    assert sum(r.n_tokens for r in small) <= 500
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).count() == len(found)


def test_sharding(spark, docs):
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text_sha256) for r in sharding.shard_documents(docs).collect())
    assert found == sorted((i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows_of())
    assert sharding.plan([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 100)]) == [["a", "b", "c", "d"], ["e"]]


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(c.sql(sql).select(*columns).fetchall()), name


def test_pipeline_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, folder)
    near = order_minhash.near_duplicates(exact_dedup.deduplicate(spark.read.parquet(f"{folder}/documents.parquet"))).filter("kept").count()
    assert out.select("doc_id").distinct().count() == near


def test_a_word_merged_otherwise_is_an_error(monkeypatch):
    """Ids of new words are lists up to the comparison with the library, and bytes in the words that are kept."""
    encoder = sentencepiece_bpe.Encoder(MODEL)
    encoder.encode("some new words")
    assert all(type(ids) is list and encoder.words[key] == np.array(ids, np.int32).tobytes() for key, ids in encoder.fresh)
    encoder.check()
    assert not encoder.fresh
    monkeypatch.setattr(encoder, "merge", lambda word: [1])
    encoder.encode("another")
    with pytest.raises(ValueError, match="another"):
        encoder.check()


def test_few_texts_are_encoded_at_once(monkeypatch):
    """Ids of a few texts at a time are held; of a batch, each fourth whole text is compared wherever the steps begin."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None if i == 40 else f"text {i} of\nsome  words " * (i % 5) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = list(sentencepiece_bpe._run(MODEL, True, 4)(iter([batch])))
    assert max(b.num_rows for b in out) <= 32
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(100))
    assert [i for b in out for i in b.column(4).to_pylist()] == library.encode([t or "" for t in texts], add_eos=True)
    compared = []

    class Seen:
        decode = library.decode

        def encode(self, given, **how):
            compared.extend(given if how.get("add_eos") else [])
            return library.encode(given, **how)

    monkeypatch.setattr(sentencepiece_bpe.encoder_of(MODEL), "library", Seen())
    monkeypatch.setattr(sentencepiece_bpe, "AT_ONCE", 6)
    list(sentencepiece_bpe._run(MODEL, False, 4)(iter([batch])))
    assert compared == [t or "" for t in texts[::4]]
