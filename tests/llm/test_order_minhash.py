"""Near-duplicates: links against brute force, recall by edit rate, the alignment against a plain one."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("weftgraph.llm")

from tests.llm.test_llm import rows_of  # noqa: E402
import weftgraph.llm.components as linked  # noqa: E402
from weftgraph.llm import order_minhash, queries  # noqa: E402

HASHES = order_minhash._Hashes()


def coded(text):
    return order_minhash.coded(order_minhash.words_of(text), HASHES)


def shared(a, b):
    x, y = order_minhash.shingles(a), order_minhash.shingles(b)
    both = len(np.intersect1d(x, y))
    return both / max(1, len(x) + len(y) - both)


def components(n, links):
    label = list(range(n))
    for a, b in links:
        if label[a] != label[b]:
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    return label


def check(rows, classes, least=0.5):
    """Classes join nothing that links of 0.8 don't join, and part no such link of texts that share ``least``."""
    ids, codes = [i for i, _ in rows], [coded(t) for _, t in rows]
    close = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if order_minhash.similarity(codes[a], codes[b]) >= 0.8]
    loose = components(len(rows), close)
    equal = lambda a, b: len(codes[a]) == len(codes[b]) and (codes[a] == codes[b]).all()
    tight = components(len(rows), [(a, b) for a, b in close if equal(a, b) or shared(codes[a], codes[b]) >= least])
    for a, b in itertools.combinations(range(len(rows)), 2):
        same = classes[ids[a]] == classes[ids[b]]
        assert same or tight[a] != tight[b]
        assert not same or loose[a] == loose[b]
    mine = [classes[i] for i in ids]
    assert all(c == min(i for i, d in zip(ids, mine, strict=True) if d == c) for c in mine)


def _edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def _crowd(rng):
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    return [_edited(rng, base, i % 30) for i in range(80)]


def _rim(rng):
    """Chains of which the last text is close to the one before, not to the base of the family."""
    base, out = [f"r{i}" for i in range(120)], []
    for _ in range(50):
        words = base
        for n in (8, 8, 9):
            out.append(words := _edited(rng, words, n))
    return [base, *out]


def _passage(rng, size):
    """Texts with one passage in common, more or less of each text, and edited copies of a few."""
    common, out = [f"p{size}-{i}" for i in range(size)], []
    for _ in range(150):
        own = [f"o{rng.randrange(10**9)}" for _ in range(rng.randint(size // 2, 4 * size))]
        at = rng.randrange(len(own))
        out.append(own[:at] + common + own[at:])
    return out + [_edited(rng, w, len(w) // 15) for w in out[:20]]


RATES = (0.01, 0.03, 0.05, 0.08, 0.1, 0.12)
COPIES = 60


def _planted(rng):
    """Texts and their copies with words replaced, put in and left out, at each of ``RATES``."""
    out = []
    for rate in RATES:
        for _ in range(COPIES):
            words, copy = [f"w{rng.randrange(20_000)}" for _ in range(rng.randint(60, 400))], []
            for w in words:
                kind = rng.random() / rate
                copy += [w] if kind >= 1 else [] if kind < 0.2 else [f"x{rng.randrange(10**9)}"] if kind < 0.8 else [w, f"x{rng.randrange(10**9)}"]
            out += [words, copy]
    return out


CASES = {"crowd": _crowd, "rim": _rim, "short passage": lambda r: _passage(r, 60), "long passage": lambda r: _passage(r, 300), "planted": _planted}


@pytest.fixture(scope="module")
def cases(spark):
    """Rows of each case, and the class of every row; all cases are in one table, with the rows of ``rows_of``."""
    made = {"odd": [(i, t) for i, t in dict(rows_of()).items() if i is not None]}
    for at, (name, make) in enumerate(CASES.items(), 1):
        made[name] = [(at * 10_000 + i, " ".join(w)) for i, w in enumerate(make(random.Random(at)))]
    repeated = [rows_of()[3], (None, "no id"), (None, None)]
    rows = sum(made.values(), []) + repeated
    found = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert all(r.class_id is None and r.kept for r in found if r.doc_id is None)
    return made, {r.doc_id: r.class_id for r in found if r.doc_id is not None}


@pytest.mark.parametrize("name", ["odd", *list(CASES)[:-1]])
def test_classes_match_brute_force(cases, name):
    made, classes = cases
    check(made[name], classes)


def test_recall_of_planted_edits(cases):
    """The README states the recall measured here."""
    made, classes = cases
    ids, recall = [i for i, _ in made["planted"]], {}
    for k, rate in enumerate(RATES):
        mine = ids[2 * COPIES * k : 2 * COPIES * (k + 1)]
        recall[rate] = sum(classes[a] == classes[b] == a for a, b in zip(mine[::2], mine[1::2], strict=True)) / COPIES
        assert all(classes[a] == a for a in mine[::2])
    print(recall)
    assert all(v == 1 for rate, v in recall.items() if rate <= 0.08) and all(v >= 0.9 for v in recall.values())


def plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[-1]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_bits_give_the_longest_common_subsequence(a, b):
    assert order_minhash._lcs(a, b) == plain(a, b)
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert order_minhash._common(x, y) == sum(min(a.count(v), b.count(v)) for v in set(a))
    one, two = order_minhash.similarity(x, y), order_minhash.similarity(y, x)
    assert one == two and (one == 0 or not a or 0.8 <= one <= plain(a, b) / max(len(a), len(b)) + 1e-9)


def test_alignment_of_edited_texts_is_the_plain_one():
    rng = random.Random(8)
    for _ in range(150):
        words = [rng.randrange(300) for _ in range(rng.randint(20, 200))]
        other = [w if rng.random() > 0.08 else rng.randrange(300) for w in words]
        if rng.random() < 0.5:
            other.insert(rng.randrange(len(other)), 7)
        want = plain(words, other) / max(len(words), len(other))
        got = order_minhash.similarity(np.array(words, np.uint64), np.array(other, np.uint64))
        assert got <= want + 1e-9 and (want < 0.82 or got >= want - 0.01)


def test_long_texts_align_in_bounded_time():
    import time

    rng = np.random.default_rng(1)
    a = rng.integers(0, 5000, 400_000).astype(np.uint64)
    b = a.copy()
    b[rng.integers(0, len(b), 30_000)] = 5001
    began = time.perf_counter()
    assert order_minhash.similarity(a, b) > 0.9
    assert order_minhash.similarity(a, rng.integers(2000, 7000, 400_000).astype(np.uint64)) == 0
    assert time.perf_counter() - began < 30


def test_query_keeps_every_row(spark):
    folder = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op5_order_minhash"](spark, folder).collect()
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(table)
    check(sorted(table.items()), {r.doc_id: r.class_id for r in rows})


def test_deals_make_rows_only_for_buckets_of_several(spark, monkeypatch):
    """Of the spots of texts with a common passage, those that no other text has are left out before they are rows."""
    made, plain_one = [], order_minhash.materialise

    def counted(df, label):
        out = plain_one(df, label)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(order_minhash, "materialise", counted)
    texts = [(i, " ".join(w)) for i, w in enumerate(_passage(random.Random(5), 60))]
    order_minhash._anew(spark.createDataFrame(texts, "doc_id long, text string"), 0.8)
    made = dict(made)
    assert made["rows"] <= made["spread"] <= 1.2 * made["rows"] + 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_of_few_links(links):
    pairs = np.array(links, np.int64).reshape(-1, 2)
    nodes, labels = linked.labelled(pairs[:, 0], pairs[:, 1])
    want = components(31, links)
    assert nodes.tolist() == sorted({v for pair in links for v in pair})
    assert all(want[v] == label for v, label in zip(nodes.tolist(), labels.tolist(), strict=True))


def test_components_in_few_jobs(spark, monkeypatch):
    """A few links take a few jobs however long their chains are; rounds of joins give the same labels."""
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(205, 200), (200, 205), (201, 201)]
    table = spark.createDataFrame(links, "a long, b long").repartition(3)
    spark.sparkContext.setJobGroup("few links", "")
    found = {r.node: r.label for r in linked.components(table).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    spark.sparkContext.setJobGroup("other", "")
    assert len(jobs) <= 6
    monkeypatch.setattr(linked, "MAX_LINKS", 0)
    rounds = {r.node: r.label for r in linked.components(table).collect()}
    del found[201]  # a link with itself is no link in rounds
    assert found == rounds and found[60] == 0 and found[129] == 100 and found[205] == 200
    assert not linked.components(table.limit(0)).collect()


def test_one_python_node_a_stage(spark, monkeypatch):
    """Sums are graded by the worker that makes them, as two Python nodes in a stage take two workers a core; any number of parts and rounds gives the plain counts."""
    frame = type(spark.range(0))
    plans, plain_one = [], frame.collect

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain_one(df)

    rows = [(i, " ".join(w)) for i, w in enumerate(_passage(random.Random(5), 40))]
    counts = np.bincount(np.concatenate([order_minhash.shingles(coded(t)) >> np.uint64(42) for _, t in rows]).astype(np.int64), minlength=order_minhash.CELLS)
    monkeypatch.setattr(frame, "collect", seen)
    monkeypatch.setattr(order_minhash, "ARITY", 2)
    for parts in (1, 2, 5):
        texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        assert (order_minhash._rarity(texts)[0] == order_minhash._grade(counts)).all()
        spots = spark.createDataFrame([(i, [(7 + i % 3, 0, True), (100 + i, 0, True)]) for i in range(9)], "doc long, spots array<struct<bucket: long, at: long, lead: boolean>>")
        bits = np.unpackbits(order_minhash._shared_keys(spots.repartition(parts, "doc")))
        assert np.flatnonzero(bits).tolist() == sorted(order_minhash._cell_of(np.array([7, 8, 9])).tolist())
    for plan in plans:
        stages = plan.split("== Initial Plan ==")[0].split("Exchange")
        assert all(stage.count("InArrow") <= 1 for stage in stages), plan
