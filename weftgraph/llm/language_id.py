"""Language identification by multilingual mixture inference.

A model of letter trigrams is learnt for each label, and beside these a background that knows
how frequent letters are but not in what order. A document is taken as a mixture of languages
and background: expectation-maximisation estimates their proportions from the trigram
likelihoods, and the set of languages is the one with the best likelihood after a
penalty for each language beyond the first. The language of the largest proportion is
predicted; the proportion of the background is that of text in no language the model knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_caches, free_name, materialise, release_memory, small_batches, text_of

#: The model is fitted on at most this many labelled texts, those with the smallest hashes.
SAMPLE = 8_000
#: Trigrams and letters that the model knows.
GRAMS = 20_000
LETTERS = 124
#: Up to this many languages, sets are shortened by one language a step; above, by half.
FINE = 8
#: Expectation-maximisation ends when no proportion moves by more, and after so many rounds at the latest.
TOLERANCE = 2e-3
ROUNDS = 100
#: Trigrams that the prior proportions weigh as much as, and the background's part of them.
PRIOR = 1.0
PRIOR_BACKGROUND = 0.05
#: Penalty for a further language, in units of log(trigrams) / 2; trigrams overlap, so more than 1.
PENALTY = 4.0
UNDETERMINED = "und"
#: Least proportion of known languages in a text that isn't rejected.
LEAST_KNOWN = 0.5

SPACE, OTHER, FIRST = 0, 1, 2


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """For each code point the lower-case letter's code point, or 0 if it's no letter."""
    return np.fromiter((ord(ch.lower()[0]) if (ch := chr(c)).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)


@dataclass
class Model:
    languages: list[str]
    letters: np.ndarray
    grams: np.ndarray
    logs: np.ndarray
    priors: np.ndarray

    @property
    def classes(self) -> np.ndarray:
        """Class of each code point: 0 for no letter, 1 for a letter that the model doesn't know."""
        low = _lowered()
        of = np.full(0x110000, OTHER, np.uint8)
        of[self.letters] = np.arange(FIRST, FIRST + len(self.letters), dtype=np.uint8)
        out = of[low]
        out[low == 0] = SPACE
        return out

    @property
    def table(self) -> np.ndarray:
        out = np.full(1 << 21, len(self.grams), np.int32)
        out[self.grams] = np.arange(len(self.grams))
        return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trigrams(classes: np.ndarray) -> np.ndarray:
    """Codes of the trigrams of a text's letter classes, runs of other characters being one space."""
    c = np.concatenate(([SPACE], classes, [SPACE]))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
    c = c[keep].astype(np.int32)
    return (c[:-2] << 14) | (c[1:-1] << 7) | c[2:]


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = _lowered()
    total = np.zeros(0x110000, np.int64)
    for batch in batches:
        total += np.bincount(low[codes_of("".join(batch.column(1).to_pylist()))], minlength=0x110000)
    found = np.flatnonzero(total[1:]) + 1
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["letter", "n"])


def _grams(classes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            grams: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams.setdefault(lang, []).append(trigrams(classes[codes_of(text)]))
            for lang, found in grams.items():
                counts[lang] = counts.get(lang, 0) + np.bincount(np.concatenate(found), minlength=1 << 21)
        for lang, count in counts.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(count[at], pa.int64())], names=["lang", "gram", "n"])

    return run


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` distinct texts among the ``usable`` rows with a label; None if there is none."""
    spark = docs.sparkSession
    known = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    first = known.groupBy(F.xxhash64(text_col).alias("h")).agg(F.min(id_col).alias(id_col))
    ids = first.orderBy("h").limit(sample).select(id_col)
    rows = materialise(known.join(F.broadcast(ids), id_col).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), "labelled")
    letters = rows.mapInArrow(_letters, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    letters = sorted(((r.letter, r.n) for r in letters.orderBy(F.desc("n"), "letter").limit(LETTERS).collect()))
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not letters or not shares:
        return None
    languages = sorted(shares)
    blank = Model(languages, np.array([c for c, _ in letters], np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    shared = spark.sparkContext.broadcast(blank)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grams(shared.value.classes)(batches)

    counts = materialise(rows.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    top = counts.groupBy("gram").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "gram").limit(GRAMS).select("gram")
    told = counts.join(F.broadcast(top), "gram").toArrow()
    codes, at = np.unique(told["gram"].to_numpy(), return_inverse=True)
    n = np.zeros((len(codes), len(languages)))
    np.add.at(n, (at, np.searchsorted(languages, told["lang"].to_pylist())), told["n"].to_numpy())
    logs = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * len(n)))
    # of a trigram that the model doesn't know, each language had less than one
    logs = np.vstack([logs, np.full(len(languages), np.log(0.5 / (n.sum() + 1)))])
    return Model(languages, blank.letters, codes, np.hstack([logs, _background(codes, n.sum(axis=1))[:, None]]), _priors([shares[v] for v in languages]))


def _background(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log chances of the trigrams if letters came in any order, and at last of a trigram that the model doesn't know."""
    parts = np.stack([codes >> 14, (codes >> 7) & 127, codes & 127])
    chance = np.log((np.bincount(parts[1], n, minlength=128) + 0.5) / (n.sum() + 64))
    known = chance[parts].sum(axis=0)
    return np.append(known, known.mean())


def _priors(texts: list[int]) -> np.ndarray:
    share = np.array(texts, float) / sum(texts)
    return np.append(share * (1 - PRIOR_BACKGROUND), PRIOR_BACKGROUND)


def _mixed(counts: np.ndarray, chances: np.ndarray, priors: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document by expectation-maximisation; ``priors`` has a row for each document."""
    of = np.repeat(np.arange(len(starts)), sizes)
    total = np.add.reduceat(counts, starts)[:, None] + PRIOR
    priors = priors / priors.sum(axis=1, keepdims=True)
    share, ones = priors, np.ones(chances.shape[1])
    todo, mine, part_counts, part_of, part_starts = np.arange(len(starts)), chances, counts, of, starts
    for _ in range(ROUNDS):
        part = mine * share[todo][part_of]
        part *= (part_counts / (part @ ones))[:, None]
        fresh = (np.add.reduceat(part, part_starts, axis=0) + PRIOR * priors[todo]) / total[todo]
        moved = np.abs(fresh - share[todo]).max(axis=1) > TOLERANCE
        share = share.copy()
        share[todo] = fresh
        if not moved.any():
            break
        if moved.sum() < 0.7 * len(todo):
            keep = moved[part_of]
            todo, mine, part_counts = todo[moved], mine[keep], part_counts[keep]
            part_sizes = sizes[todo]
            part_of, part_starts = np.repeat(np.arange(len(todo)), part_sizes), np.concatenate(([0], np.cumsum(part_sizes)[:-1]))
    return share, np.add.reduceat(counts * np.log((chances * share[of]) @ ones), starts)


def _fewer(k: int) -> int:
    return k - 1 if k <= FINE else max(FINE, k // 2)


def predict(model: Model, classes: np.ndarray, table: np.ndarray, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, its proportion and the proportion of all known languages, for each text.

    Sets of languages are tried from all languages down to one, without those of the least proportion at each step.
    """
    languages, scores, fits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    rows, grams, counts = [], [], []
    for i, text in enumerate(texts):
        kinds = classes[codes_of(text or "")]
        if not kinds.any():
            continue
        n = np.bincount(table[trigrams(kinds)], minlength=len(model.logs))
        at = np.flatnonzero(n)
        rows.append(i)
        grams.append(at)
        counts.append(n[at])
    if not rows:
        return languages, scores, fits
    sizes = np.array(list(map(len, grams)))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    gram, count = np.concatenate(grams), np.concatenate(counts).astype(float)
    of, n_languages = np.repeat(np.arange(len(rows)), sizes), len(model.languages)
    peak = model.logs.max(axis=1)
    chances = np.exp(model.logs - peak[:, None])[gram]
    price = PENALTY * np.log(np.maximum(np.add.reduceat(count, starts), 2)) / 2
    order = np.broadcast_to(np.arange(n_languages), (len(rows), n_languages))
    best, chosen, score, fit_ = np.full(len(rows), -np.inf), np.zeros(len(rows), int), np.zeros(len(rows)), np.zeros(len(rows))
    k = n_languages
    while k:
        used = np.hstack([order[:, :k], np.full((len(rows), 1), n_languages)])
        share, likelihood = _mixed(count, np.take_along_axis(chances, used[of], axis=1), model.priors[used], starts, sizes)
        by_share = np.argsort(-share[:, :k], axis=1, kind="stable")
        order = np.take_along_axis(order[:, :k], by_share, axis=1)
        likelihood = likelihood - (k - 1) * price
        better = likelihood > best
        best = np.where(better, likelihood, best)
        chosen = np.where(better, order[:, 0], chosen)
        score = np.where(better, share[:, :k].max(axis=1), score)
        fit_ = np.where(better, share[:, :k].sum(axis=1), fit_)
        k = _fewer(k)
    for i, c, x, y in zip(rows, chosen.tolist(), score.tolist(), fit_.tolist(), strict=True):
        languages[i], scores[i], fits[i] = model.languages[c], min(1.0, max(0.0, x)), min(1.0, max(0.0, y))
    return languages, scores, fits


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "lang_pred", score: str = "score", known: str = "known") -> DataFrame:
    """``docs`` with the predicted language, its proportion and that of all known languages (0 to 1), from the text alone.

    ``und`` with zeros if the text is null or has no letter, or if there is no model. A text in
    letters or orders of letters that the model doesn't know has a language, but proportions near 0. Other
    columns pass unread, whatever their names, as long as they aren't the three new ones.
    """
    spark = docs.sparkSession
    if model is None:
        return docs.withColumns({name: F.lit(UNDETERMINED), score: F.lit(0.0), known: F.lit(0.0)})
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        held = shared.value
        classes, table = held.classes, held.table
        for batch in batches:
            languages, *numbers = predict(held, classes, table, batch.column(at).to_pylist())
            more = [pa.array(languages, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, name, score, known])
        release_memory()

    schema = docs.select("*", F.lit("").alias(name), F.lit(0.0).alias(score), F.lit(0.0).alias(known)).schema
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, known.

    Learns from text and lang of the rows that aren't held out (crc32 of the id, modulo 4,
    isn't 2) on a bounded sample; rows with a null id, text or label teach nothing. Every row gets
    a prediction. Repeated rows get equal ones; an empty table gives an empty result.
    """
    model = fit(docs, ~held_out())
    narrow = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return with_language(narrow, model).drop("text")


def reject(docs: DataFrame, least: float = LEAST_KNOWN) -> DataFrame:
    """``docs`` without the rows of no language: those without a letter, and those of which known languages explain less than ``least``.

    A text in several known languages stays, in whatever parts. Without any label nothing can be
    told from anything, and only texts without letters go.
    """
    model = fit(docs, ~held_out())
    if model is None:
        return docs.filter(text_of().rlike(r"\p{L}"))
    name, score, known = free_name(docs, "__lang_pred"), free_name(docs, "__lang_score"), free_name(docs, "__lang_known")
    named = with_language(docs, model, name=name, score=score, known=known)
    return named.filter((F.col(name) != UNDETERMINED) & (F.col(known) >= least)).drop(name, score, known)
