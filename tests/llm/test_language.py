"""Language ID: held-out accuracy, unknown scripts and junk, mixtures, the set search against all sets."""

import itertools
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("weftgraph.llm")

from pyspark.sql import functions as F  # noqa: E402
from weftgraph.llm import language_id, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
UNKNOWN = [
    "これは日本語の文章です。今日は天気がいいですね。",
    "Это русский текст о погоде и природе, который никто не читал.",
    "asdfgh qwertyuiop zxcvbnm lkjhgf poiuyt mnbvcxz qazwsx edcrfv",
    "xkcd zzzq wwqx jjkv ppqz vvbn",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language_id.fit(docs, ~language_id.held_out())


def _mixtures(docs, model):
    texts = {r.lang: r.text.split() for r in docs.filter("lang is not null and length(text) > 1500").groupBy("lang").agg(F.max_by("text", "doc_id").alias("text")).collect()}
    return [" ".join(" ".join(texts[v][:60]) for v in some) for n in range(1, 5) for some in itertools.combinations(model.languages, n)]


def test_query_on_held_out_texts(spark, docs):
    rows = queries.QUERIES["op8_language_id"](spark, FOLDER).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] is not None]
    assert len(held) > 100 and sum(held) / len(held) > 0.99


def test_rejects_what_it_cannot_read_and_keeps_mixtures(spark, docs, model):
    mixed = _mixtures(docs, model)
    more = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([*UNKNOWN, None, "", "12 !", *mixed])], "doc_id long, text string")
    kept = {r.doc_id for r in language_id.reject(docs.unionByName(more, allowMissingColumns=True)).select("doc_id").collect()}
    n_bad = len(UNKNOWN) + 3
    assert kept.isdisjoint(range(10**9, 10**9 + n_bad))
    assert kept >= set(range(10**9 + n_bad, 10**9 + n_bad + len(mixed)))
    lost = docs.filter(~F.col("doc_id").isin(list(kept))).collect()
    assert len(lost) < 0.01 * docs.count() and all(len(r.text or "") < 200 for r in lost)


def test_mixtures_have_their_languages(docs, model):
    mixed = _mixtures(docs, model)
    sets = [some for n in range(1, 5) for some in itertools.combinations(model.languages, n)]
    languages, scores, known = language_id.predict(model, model.classes, model.table, [*mixed, *UNKNOWN])
    for some, language, score, fit in zip(sets, languages, scores, known, strict=False):
        assert language in some and fit > 0.9 and abs(score - 1 / len(some)) < 0.12
    assert max(scores[len(mixed) :]) < 0.2


def test_chosen_set_is_the_best_of_all_sets(docs, model):
    """Brute force over every set of languages."""
    rng = random.Random(4)
    texts = [" ".join(rng.sample(t.split(), min(30, len(t.split())))) for t in _mixtures(docs, model)]
    languages, scores, _ = language_id.predict(model, model.classes, model.table, texts)
    for text, language, score in zip(texts, languages, scores, strict=True):
        n = np.bincount(model.table[language_id.trigrams(model.classes[language_id.codes_of(text)])], minlength=len(model.logs))
        gram = np.flatnonzero(n)
        count, best = n[gram].astype(float), None
        for size in range(1, len(model.languages) + 1):
            for some in itertools.combinations(range(len(model.languages)), size):
                used = np.array([*some, len(model.languages)])
                share, likelihood = language_id._mixed(count, np.exp(model.logs[gram][:, used]), model.priors[used][None, :], np.array([0]), np.array([len(gram)]))
                value = likelihood[0] - (size - 1) * language_id.PENALTY * np.log(max(count.sum(), 2)) / 2
                if best is None or value > best[0]:
                    best = value, model.languages[some[share[0, :-1].argmax()]], share[0, :-1].max()
        assert language == best[1] and abs(score - best[2]) < 0.05


def test_no_labels_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "some text", None, 1.0), (2, "12", None, 2.0), (None, None, None, 3.0)], "doc_id long, text string, lang string, score double")
    assert [r.lang_pred for r in language_id.identify(rows).collect()] == ["und"] * 3
    kept = language_id.reject(rows).collect()
    assert [r.doc_id for r in kept] == [1] and kept[0].score == 1.0
