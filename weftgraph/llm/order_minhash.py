"""Near-duplicate detection with Order MinHash.

A text is its lower-cased words between white space; its shingles are runs of five
words, each labelled with its occurrence number. A sketch takes the ``PICKS`` shingles
with the smallest hashes and keeps them in text order, so two texts share it only if they
share these shingles in the same order: the more alike in edits, the likelier.
Texts that share a sketch are candidates. Candidates are verified by a banded alignment of
their words: shingles that both texts have, no further off the diagonal than any passing
alignment goes, are anchors, and the words between anchors are aligned exactly. The
similarity is aligned words / words of the longer text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import MAX_HOT_GROUPS, drop_caches, join_groups, materialise, release_memory, small_batches
from .components import components

WORDS = 5
THRESHOLD = 0.8
#: Sketches for each text, and shingles in each. Of two texts that share a part j of their shingles (shared / all), a sketch
#: is shared with probability j ** 2, at least one of 32 with 0.98 at j = 0.35 (about one word in eight edited) and 0.9999 at 0.5.
SKETCHES = 32
PICKS = 2
#: Buckets in which more than ``CROWD`` texts aren't close to their leader (texts that only share a passage, say) are
#: dealt anew: by their rarest shingles, which misses no pair that shares ``THRESHOLD`` of its shingles, and by
#: sketches of those shingles that aren't frequent in crowded buckets, so that a common passage doesn't make a bucket.
CROWD = 16
#: Leaders a bucket in one round of ``_mended``: CROWD at first, four times as many in each round, up to this.
MOST_LEADERS = 256
#: Counters (64 blocks of 65,536) that estimate how often a shingle occurs in crowded buckets.
CELLS = 1 << 22
BLOCK = 1 << 16
ARITY = 64
#: A shingle is frequent from this many times the mean of the counters.
FREQUENT = 16
#: Sets the keys of prefixes and of sketches of crowded buckets apart from others.
_AGAIN = np.uint64(0x1B873593CC9E2D51)
#: Texts up to this many shingles also share a smallest-hash prefix, which misses no pair that shares ``THRESHOLD`` of its shingles.
SHORT = 20
#: A worker forgets its word hashes beyond this many.
MAX_WORDS_KEPT = 100_000

_SEEDS = np.random.default_rng(20_240_229).integers(1, 2**63, size=(2, SKETCHES), dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def coded(words: list[str], hashes: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingles(w: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of coded words in text order; a text below five words has one."""
    if not len(w):
        return w
    size = min(WORDS, len(w))
    x = w[: len(w) - size + 1].copy()
    for i in range(1, size):
        x = x * _P + w[i : len(w) - size + 1 + i]
    x = _mix(x)
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if len(same):
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        nth = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
        label = np.empty(len(x), np.uint64)
        label[order] = nth.astype(np.uint64)
        x = np.where(label > 0, _mix(x + label * _P), x)
    return x


def sketch(x: np.ndarray) -> np.ndarray:
    """Bucket keys of a text with labelled shingles ``x``; none for a text without words."""
    if not len(x):
        return np.zeros(0, np.int64)
    y = (x[None, :] ^ _SEEDS[0][:, None]) * (_SEEDS[1][:, None] | np.uint64(1))
    y ^= y >> np.uint64(31)
    picks, rows = [], np.arange(SKETCHES)
    for _ in range(min(PICKS, len(x))):
        at = y.argmin(axis=1)
        picks.append(at)
        y[rows, at] = np.uint64(2**64 - 1)
    spots = np.sort(np.stack(picks, axis=1), axis=1)
    key = rows.astype(np.uint64) * _Q
    for i in range(spots.shape[1]):
        key = _mix(key * _P + x[spots[:, i]])
    if len(x) <= SHORT:
        prefix = np.sort(x)[: len(x) - int(np.ceil(THRESHOLD * len(x) - 1e-9)) + 1]
        key = np.concatenate([key, _mix(prefix + np.uint64(77))])
    return np.unique(key.view(np.int64))


def _lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits."""
    spots: dict[int, int] = {}
    for i, word in enumerate(a):
        spots[word] = spots.get(word, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for word in b:
        if hit := row & spots.get(word, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that both texts have, each as often as in the text that has it less."""
    both = np.sort(np.concatenate([np.unique(a), np.unique(b)]))
    both = both[:-1][both[1:] == both[:-1]]
    count = lambda x: np.bincount(at := np.searchsorted(both, x), (both[np.minimum(at, len(both) - 1)] == x), minlength=len(both) + 1)
    return int(np.minimum(count(a), count(b))[:-1].sum()) if len(both) else 0


def _chain(spots: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails, ends, before = [], [], []
    for k, q in enumerate(spots):
        at = bisect_left(tails, q)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(q)
            ends.append(k)
        else:
            tails[at], ends[at] = q, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned words of two coded texts over the words of the longer; 0.0 as soon as ``threshold`` is out of reach.

    Symmetric. Two texts without words have 1.0.
    """
    if (len(b), b.tobytes()) < (len(a), a.tobytes()):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    least = int(np.ceil(threshold * len(b) - 1e-9))
    if len(a) < least or _common(a, b) < least:
        return 0.0
    _, i, j = np.intersect1d(shingles(a), shingles(b), assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= len(a) + len(b) - 2 * least
    order = np.argsort(i[inside])
    i, j = i[inside][order], j[inside][order]
    if (j[1:] < j[:-1]).any():
        chain = _chain(j.tolist())
        i, j = i[chain], j[chain]
    # an anchor is the first word of a shared shingle; gaps lie before, between and after anchors
    i, j = np.concatenate([[-1], i, [len(a)]]), np.concatenate([[-1], j, [len(b)]])
    wide, high = np.diff(i) - 1, np.diff(j) - 1
    gaps = np.flatnonzero(np.minimum(wide, high))
    reach = len(i) - 2 + int(np.minimum(wide, high)[gaps].sum())
    for g in gaps.tolist():
        if reach < least:
            return 0.0
        left, right = a[i[g] + 1 : i[g + 1]].tolist(), b[j[g] + 1 : j[g + 1]].tolist()
        most, same = min(len(left), len(right)), 0
        while same < most and left[same] == right[same]:
            same += 1
        reach += same + _lcs(left[same:], right[same:]) - most
    return reach / len(b) if reach >= least else 0.0


_SKETCHED = "doc_id long, key binary, words long, buckets array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_caches()
    hashes = _Hashes()
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("words", pa.int64()), ("buckets", pa.list_(pa.int64()))])
    for batch in batches:
        keys, sizes, buckets = [], [], []
        for text in batch.column(1):
            words = words_of(text.as_py())
            keys.append(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            sizes.append(len(words))
            buckets.append(sketch(shingles(coded(words, hashes))).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))], schema=schema)
    hashes.clear()
    release_memory()


def _cells(texts: pa.Array, hashes: dict[str, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words, shingles and their counters of each text."""
    for text in texts:
        w = coded(words_of(text.as_py()), hashes)
        x = shingles(w)
        yield len(w), x, (x >> np.uint64(42)).astype(np.int64)


_COUNTS = "part int, block int, counts binary"


def _blocks(cells: np.ndarray) -> pa.RecordBatch:
    """One task's counters, by blocks that aren't empty."""
    full = [i for i in range(CELLS // BLOCK) if cells[i * BLOCK : (i + 1) * BLOCK].any()]
    part = TaskContext.get().partitionId()
    data = [cells[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in full]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["part", "block", "counts"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_caches()
    hashes, cells = _Hashes(), np.zeros(CELLS, np.uint32)
    for batch in batches:
        for _, _, at in _cells(batch.column(1), hashes):
            np.add.at(cells, at, 1)
    yield _blocks(cells)
    hashes.clear()
    release_memory()


def _cell_of(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * _P >> np.uint64(42)).astype(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(CELLS, np.uint32)
    for batch in batches:
        np.add.at(cells, _cell_of(batch.column(0).flatten().to_numpy(zero_copy_only=False)), 1)
    yield _blocks(cells)


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.uint32)
    for data in table.column("counts"):
        total += np.frombuffer(data.as_py(), np.uint32)
    return pa.table({"part": table.column("part").slice(0, 1), "block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _totals(rows: DataFrame, counted, told, schema: str) -> DataFrame:
    """What ``told`` says of the blocks of counters, summed in a tree, so that no task holds more than ``ARITY`` tasks' blocks.

    The last sums are told by the worker that makes them: a stage with two Python nodes starts two workers a core,
    which outlive it and take turns at all later tasks, so that what a worker keeps is kept twice over.
    """
    parts = materialise(rows.mapInArrow(counted, _COUNTS), "counts")
    most = parts.agg(F.max("part")).first()[0] or 0
    if not most:
        return parts.mapInArrow(told, schema)

    def last(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(told(_summed(table).to_batches()))

    while most:
        most //= ARITY
        groups = parts.withColumn("part", F.floor(F.col("part") / ARITY).cast("int")).groupBy("part", "block")
        parts = groups.applyInArrow(_summed, _COUNTS) if most else groups.applyInArrow(last, schema)
    return parts


def _grade(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: 0 and 1 as they are, others by eighths of powers of two."""
    return np.where(counts > 0, 1 + np.minimum(254, 8 * np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)


def _graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.frombuffer(data.as_py(), np.uint32) for data in batch.column(2)]
        columns = [batch.column(1), pa.array([_grade(c).tobytes() for c in counts], pa.binary())]
        columns += [pa.array([int(f(c)) for c in counts], pa.int64()) for f in (np.sum, np.count_nonzero)]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "grades", "total", "used"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(np.frombuffer(data.as_py(), np.uint32) > 1).tobytes() for data in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bits, pa.binary())], names=["block", "bits"])


def _rarity(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Grades of how often the shingles of ``texts`` occur, and the grade from which one is frequent (that above ``FREQUENT`` means)."""
    grades, total, used = np.zeros(CELLS, np.uint8), 0, 0
    for row in _totals(texts, _counted, _graded, "block int, grades binary, total long, used long").collect():
        grades[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.grades, np.uint8)
        total, used = total + row.total, used + row.used
    return grades, int(_grade(np.array(FREQUENT * total / max(1, used)))) + 1


def _shared_keys(spots: DataFrame) -> np.ndarray:
    """Bits of the counters that several bucket keys of ``spots`` meet in; a key elsewhere is that of one text."""
    bits = np.zeros(CELLS // 8, np.uint8)
    for row in _totals(spots.select(F.col("spots.bucket").alias("buckets")), _keyed, _repeated, "block int, bits binary").collect():
        bits[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def _spots(x: np.ndarray, often: np.ndarray, frequent: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, place in the order of rarity and whether it may lead, for each spot of a text of a crowded bucket."""
    n = len(x)
    follow = n - int(np.ceil(threshold * n - 1e-9)) + 1
    lead = n - int(np.ceil(2 * threshold / (1 + threshold) * n - 1e-9)) + 1
    order = np.lexsort((x, often))[:follow]
    place = np.flatnonzero(often[order] > 1)
    again = sketch(_mix(x[(often > 1) & (often < frequent)] ^ _AGAIN))
    keys = np.concatenate([x[order[place]].view(np.int64), again])
    return keys, np.concatenate([place, np.zeros(len(again), np.int64)]), np.concatenate([place < lead, np.ones(len(again), bool)])


def _dealt(grades: np.ndarray, frequent: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sizes, ends, found = [], [0], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
            for words, x, at in _cells(batch.column(1), hashes):
                found.append(_spots(x, grades[at], frequent, threshold))
                sizes.append(words)
                ends.append(ends[-1] + len(found[-1][0]))
            columns = [pa.array(np.concatenate(column)) for column in zip(*found, strict=True)]
            spots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["bucket", "at", "lead"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), spots], names=["doc", "n", "spots"])
        hashes.clear()
        release_memory()

    return run


def _met(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(2).flatten()
            keys = spots.field("bucket").to_numpy(zero_copy_only=False)
            at = _cell_of(keys)
            kept = pa.array(np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1))
            of = pa.array(np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))).take(kept)
            columns = [batch.column(0).take(of), batch.column(1).take(of), *(spots.field(name).take(kept) for name in ("bucket", "at", "lead"))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "bucket", "at", "lead"])
        release_memory()

    return run


def _anew(texts: DataFrame, threshold: float) -> DataFrame:
    """``_rows`` of the texts of crowded buckets, dealt by prefixes and by sketches of their shingles that aren't frequent.

    With the n shingles of a text in order of rarity, two texts that share ``threshold`` of them have one in common among
    the first n - ceil(threshold * n) + 1 of the longer (it may follow) and the first
    n - ceil(2 * threshold / (1 + threshold) * n) + 1 of the shorter (it may lead). Any order will
    do; rarity is estimated by ``CELLS`` counters, so a shingle counted once has no partner. As many counters
    tell most buckets that have one text only, before any of their rows are made; results don't depend on them.
    """
    context = texts.sparkSession.sparkContext
    held = context.broadcast(_rarity(texts))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(*held.value, threshold)(batches)

    found = materialise(texts.mapInArrow(dealt, "doc long, n long, spots array<struct<bucket: long, at: long, lead: boolean>>"), "spots")
    held.destroy()
    several = context.broadcast(_shared_keys(found))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _met(several.value)(batches)

    spread = materialise(found.mapInArrow(met, "doc long, n long, bucket long, at long, lead boolean"), "spread")
    several.destroy()
    return _rows(spread, -F.first("n"))


def _rows(spread: DataFrame, rank: Column) -> DataFrame:
    """``bucket, doc, n, at, rank, lead`` of the rows of ``spread`` whose bucket has another text and one to lead."""
    several = materialise(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max("lead").alias("led")).filter("size > 1 and led").drop("led"), "buckets")
    sizes = several.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows")).first()
    n_blocks = bloom.blocks_for(sizes.n)
    shared = bloom.probe(spread, F.col("bucket"), bloom.build(several, "bucket", n_blocks), n_blocks).filter("__maybe").drop("__maybe")
    shared = join_groups(shared, several, "bucket", "size", sizes.rows)
    by_doc = shared.groupBy("doc").agg(rank.alias("rank"), F.first("n").alias("n"), F.collect_list(F.struct("bucket", "at", "lead")).alias("spots"))
    spots = by_doc.select("doc", "rank", "n", F.explode("spots").alias("spot"))
    return materialise(spots.select("spot.bucket", "doc", "n", "spot.at", "rank", "spot.lead"), "rows")


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        last, x = None, None
        for batch in batches:
            near = []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, x = a, coded(words_of(left.as_py()), hashes)
                near.append(similarity(x, coded(words_of(right.as_py()), hashes), threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.float64())], names=["a", "b", "similarity"])
        hashes.clear()
        release_memory()

    return run


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, total: int) -> DataFrame:
    """``a, b, similarity`` of the ``total`` distinct ``pairs`` (a, b); a leader with many partners is salted."""
    limit = max(256, total // MAX_HOT_GROUPS)
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    salts = F.broadcast(counts.select("a", F.ceil(F.col("__n") / limit).cast("int").alias("__salts")))
    salted = pairs.join(salts, "a", "left").withColumn(
        "__salt", F.pmod(F.xxhash64("b"), F.coalesce("__salts", F.lit(1))).cast("int")
    ).drop("__salts")
    with_b = salted.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    left = left.join(salts, "a", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    both = with_b.join(left.drop("__salts"), ["a", "__salt"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verified(threshold), "a long, b long, similarity double")


def _within(other: str, at: str, threshold: float) -> Column:
    """Whether lengths, and places in the order of rarity, allow a pair of ``threshold``."""
    mine, its = (F.greatest(F.col(n) - WORDS + 1, F.lit(1)) for n in ("n", other))
    least = F.ceil(threshold / (1 + threshold) * (mine + its) - 1e-9)
    long_enough = F.least(F.col("n"), F.col(other)) >= threshold * F.greatest(F.col("n"), F.col(other)) - 1e-9
    placed = (least <= mine - F.col("at")) & (least <= its - F.col(at))
    return long_enough & (placed | ((F.col("at") == 0) & (F.col(at) == 0)))


def _links(rows: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Verified links among ``rows`` (bucket, doc, n, at, rank, lead), and the pairs that were tested (a < b in both).

    Every bucket elects as leader the text of the highest rank (the one that shares most
    buckets with others); the rest are aligned with it, unless their lengths, or their places
    in the order of rarity, rule out ``threshold``. Texts that aren't close to their
    leader go on to the next round with more leaders a bucket, until no text can lead.
    After the first round the texts of crowded buckets are dealt anew by ``_anew``, which
    ranks the shortest first; there a text that may only follow isn't compared with a lower rank.
    A text close to a leader isn't compared with the rest of the bucket here; see ``_mended``.
    """
    found, tried, leaders, rounds = [], [], 1, 0
    while (total := rows.count()) and rows.filter("lead").limit(1).count():
        standing = F.struct("rank", (-F.col("doc")).alias("minus"))
        part = F.pmod(F.xxhash64("doc"), F.lit(leaders))
        chosen = rows.filter("lead").groupBy("bucket", part.alias("part")).agg(F.max(F.struct("rank", (-F.col("doc")).alias("minus"), "n", "at")).alias("top"))
        if leaders > 1:
            sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
            chosen = chosen.join(sizes, "bucket")
        else:
            sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max(F.when(F.col("lead"), F.struct("rank", (-F.col("doc")).alias("minus"), "n", "at"))).alias("top"))
            chosen = sizes.filter("top is not null")
        head = F.struct("top.rank", "top.minus")
        chosen = materialise(chosen.select("bucket", "size", head.alias("head"), F.col("top.n").alias("top_n"), F.col("top.at").alias("top_at")), "chosen")
        met = join_groups(rows, chosen, "bucket", "size", total)
        met = met.filter((F.col("doc") != -F.col("head.minus")) & (F.col("lead") | (standing < F.col("head"))))
        met = met.filter(_within("top_n", "top_at", threshold))
        met = materialise(met.select("bucket", (-F.col("head.minus")).alias("a"), F.col("doc").alias("b")), "met")
        pairs = materialise(met.select("a", "b").distinct(), "pairs")
        tested = verify(pairs, texts, threshold, pairs.count()).filter(F.col("similarity") >= threshold)
        ok = materialise(tested.select("a", "b"), "ok")
        found.append(ok)
        tried.append(pairs)
        gone = met.join(ok, ["a", "b"]).select("bucket", F.col("b").alias("doc")).unionByName(chosen.select("bucket", (-F.col("head.minus")).alias("doc")))
        left = materialise(rows.join(gone, ["bucket", "doc"], "left_anti"), "left")
        if not rounds:
            several = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max("lead").alias("led")).filter("size > 1 and led").drop("led")
            sized = materialise(join_groups(left, several, "bucket", "size", total), "sized")
            crowd = sized.filter(F.col("size") > CROWD).select(F.col("doc").alias("doc_id")).distinct()
            fine = _anew(texts.join(crowd, "doc_id").select("doc_id", "text"), threshold)
            left = materialise(sized.filter(F.col("size") <= CROWD).select(*fine.columns).unionByName(fine), "rows")
        rows = left
        rounds += 1
        leaders = leaders if rounds == 1 else leaders * 8
    none = rows.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0)
    return _ordered(reduce(DataFrame.unionByName, found, none)), _ordered(reduce(DataFrame.unionByName, tried, none))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _split(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``bucket, doc, n, at, lead, label, size, main, others`` of the rows whose bucket has texts of several classes.

    ``main`` is the class with most texts in the bucket, and ``others`` counts the texts outside it.
    """
    named = rows.select("bucket", "doc", "n", "at", "lead").join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    named = materialise(named, "named")
    classes = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = classes.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("top"))
    groups = groups.filter("size > top.n").select("bucket", "size", (-F.col("top.minus")).alias("main"), (F.col("size") - F.col("top.n")).alias("others"))
    return materialise(join_groups(named, materialise(groups, "groups"), "bucket", "size", named.count()), "split")


def _mended(rows: DataFrame, links: DataFrame, tested: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``links``, with those between texts of one bucket that are still in different classes.

    In a bucket of several classes, every text outside the largest is compared with all texts
    of other classes, unless the pair was tested before or lengths or places rule it out. So no two classes
    stay apart that a pair of a bucket links. Buckets with more than ``CROWD`` such texts are dealt anew by ``_anew``,
    the linked texts with them, and led by some of these texts a round; classes are named anew after each.
    """
    leaders, rounds = CROWD, 0
    links, tested = materialise(links, "links"), materialise(tested, "tested")
    labels = components(links)
    while True:
        split = _split(rows, labels)
        if not rounds:
            crowd = materialise(split.filter(F.col("others") > CROWD).select(F.col("doc").alias("doc_id")).distinct(), "crowd")
            if crowd.limit(1).count():
                fine = _anew(texts.join(crowd, "doc_id").select("doc_id", "text"), threshold)
                calm = split.filter(F.col("others") <= CROWD)
                columns = ["bucket", "doc", "n", "at", "lead"]
                split = _split(materialise(calm.select(*columns).unionByName(fine.select(*columns)), "rows"), labels)
        total = split.count()
        if not total:
            return links, labels
        led = split.filter("label != main")
        part = F.when(F.col("others") <= leaders, F.col("doc")).otherwise(F.pmod(F.xxhash64("doc"), F.lit(leaders)))
        heads = led.groupBy("bucket", part.alias("part")).agg(F.first("size").alias("size"), F.max(F.struct("doc", "n", "at", "lead", "label")).alias("head"))
        heads = materialise(heads.select("bucket", "size", "head"), "heads")
        met = join_groups(split.drop("size"), heads, "bucket", "size", total).filter(F.col("label") != F.col("head.label"))
        met = met.filter(_within("head.n", "head.at", threshold))
        met = met.filter((F.col("head.lead") & (F.col("head.n") <= F.col("n"))) | (F.col("lead") & (F.col("n") <= F.col("head.n"))))
        met = met.select(F.col("head.doc").alias("a"), F.col("doc").alias("b"), F.least("head.doc", "doc").alias("lo"), F.greatest("head.doc", "doc").alias("hi"))
        known = tested.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
        pairs = materialise(met.dropDuplicates(["lo", "hi"]).join(known, ["lo", "hi"], "left_anti").select("a", "b"), "pairs")
        if n_pairs := pairs.count():
            ok = materialise(_ordered(verify(pairs, texts, threshold, n_pairs).filter(F.col("similarity") >= threshold)), "ok")
            if ok.limit(1).count():
                links = materialise(links.unionByName(ok), "links")
                labels = components(links)
            tested = tested.unionByName(_ordered(pairs))
        rows = split.join(heads.select("bucket", F.col("head.doc").alias("doc")), ["bucket", "doc"], "left_anti")
        leaders = min(MOST_LEADERS, leaders * 4)
        rounds += 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, n_links, kept.

    Classes are the connected components of the verified links; texts with the same words
    are one class, texts without words (null or empty too) are one class. ``class_id`` is
    the least id of the class and its row is the one kept. ``n_links`` counts the other,
    different texts that this text was found close to. A row with a null id is kept, with a
    null class, and compared with nothing. Repeated rows with one id share its class.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = source.filter("doc_id is not null")
    base = materialise(given.mapInArrow(_sketched, _SKETCHED), "sketches")
    n_docs = base.count()
    first = base.groupBy("key").agg(F.min(F.struct("doc_id", "words", "buckets")).alias("first"), F.count(F.lit(1)).alias("copies"))
    unique = materialise(first.select("key", F.col("first.doc_id").alias("rep"), "copies", F.col("first.words").alias("n"), F.col("first.buckets").alias("buckets")), "unique")

    spread = unique.select(F.col("rep").alias("doc"), "n", F.explode("buckets").alias("bucket"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("lead"))
    rows = _rows(spread, F.sum("size"))
    ids = materialise(rows.select(F.col("doc").alias("doc_id")).distinct(), "ids")
    n_blocks = bloom.blocks_for(ids.count())
    maybe = bloom.probe(given, F.col("doc_id"), bloom.build(ids, "doc_id", n_blocks), n_blocks).filter("__maybe").drop("__maybe")
    texts = materialise(maybe.join(ids, "doc_id").groupBy("doc_id").agg(F.first("text").alias("text")), "texts")
    links, labels = _mended(rows, *_links(rows, texts, threshold), texts, threshold)

    ends = links.select(F.col("a").alias("rep")).union(links.select("b"))
    degrees = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    labels = labels.withColumnRenamed("node", "rep").join(degrees, "rep")
    named = unique.select("key", "rep", "copies").join(labels, "rep", "left")
    named = materialise(named.select("key", "copies", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    sizes = named.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    sized = join_groups(named, sizes, "class_id", "class_size", n_docs)
    out = join_groups(base.select("doc_id", "key"), sized, "key", "copies", n_docs)
    columns = ["doc_id", "class_id", "class_size", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept")]
    lone = source.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return out.select(*columns).unionByName(lone)
