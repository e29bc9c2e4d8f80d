"""HTML extraction: linear scanning, the cut against brute force, whole pages against another parser."""

import itertools
import random
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

pytest.importorskip("weftgraph.llm")

from weftgraph.llm import html_extract, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "unit", ["<a n", "<a", "<div>t.", "<b>", '<a b="', "<i b='x>", "</q><li>a", "<!-", "<!--", "<script>", "</", "<a b=\"x'\" ", "&#x", "<p><b>"]
)
def test_malformed_pages_take_linear_time(unit):
    page = "<p>Before.</p>" + unit * (10**6 // len(unit))
    began = time.perf_counter()
    html_extract.extract(page)
    assert time.perf_counter() - began < 60


def test_unclosed_tag_of_a_million_letters():
    began = time.perf_counter()
    assert html_extract.extract("<article><p>All that was said was true.</p><a " + "n" * 10**6) == "All that was said was true."
    assert time.perf_counter() - began < 5


def _cost(labels, scores, ties):
    return sum(max(0, -s) if x else max(0, s) for s, x in zip(scores, labels, strict=True)) + sum(w for i, j, w in ties if labels[i] != labels[j])


def _page(rng):
    words = "the river rose in night and people went out to look at damage".split()
    text = lambda n: " ".join(rng.choices(words, k=n)) + rng.choice(["", ".", "!"])
    shapes = [
        lambda: f"<p>{text(rng.randint(1, 14))}</p>",
        lambda: f"<h2>{text(2)}</h2>",
        lambda: f"<p><a href=x>{text(rng.randint(1, 4))}</a></p>",
        lambda: f"<div class={rng.choice(['search-algorithms', 'related', 'box', 'share'])}><p>{text(rng.randint(1, 9))}</p></div>",
        lambda: f"<form>{text(3)}<p>{text(8)}</p></form>",
    ]
    wrap = rng.choice(["{}", "<article>{}</article>", "<div class=x>{}</div>", "<div class=sidebar-box>{}</div>"])
    return "<body>" + wrap.format("".join(rng.choice(shapes)() for _ in range(rng.randint(1, 9)))) + "</body>"


def test_extraction_is_the_best_labelling_and_ties_matter(monkeypatch):
    rng, flows, changed = random.Random(11), [], 0
    real = html_extract._flow
    monkeypatch.setattr(html_extract, "_flow", lambda *a: flows.append(1) or real(*a))
    for _ in range(300):
        blocks = html_extract.blocks_of(page := _page(rng))
        if len(blocks) > 11:
            continue
        scores, ties = [html_extract.score(b) for b in blocks], html_extract.ties_of(blocks)
        labels = html_extract.label(scores, ties)
        best = min(_cost(x, scores, ties) for x in itertools.product([False, True], repeat=len(blocks)))
        assert abs(_cost(labels, scores, ties) - best) < 1e-6
        assert html_extract.extract(page) == "\n\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)
        changed += labels != [s > 0 for s in scores]
    assert len(flows) > 20 and changed > 20


def test_short_paragraph_is_kept_by_its_neighbours():
    around = "<div><p><a href=1>Home</a></p><p><a href=2>News</a></p></div>"
    page = "<div><p>The river rose by two metres in the night, and the town was flooded.</p><p>{}</p><p>By morning the water had gone, and people went out to look.</p></div>"
    assert "Nobody slept" in html_extract.extract(around + page.format("Nobody slept") + around)
    assert html_extract.extract("<p>Nobody slept</p>" + around) == ""


def test_names_do_not_throw_articles_away():
    text = "A full sentence stands here for its readers."
    for name in ("search-algorithms", "post-comments-free main", "page has-sidebar", "no-menu"):
        assert html_extract.extract(f"<div class='{name}'><p>{text}</p></div>") == text
        assert html_extract.extract(f"<div id='{name}'><article><p>{text}</p></article></div>") == text
    for name in ("comments", "comment-list", "sidebar left", "cookie-notice", "ad"):
        assert html_extract.extract(f"<article><p>{text}</p><div class='{name}'><p>{text} And more of it, at length.</p></div></article>") == text


def test_formulas_stay_and_controls_go():
    assert html_extract.extract("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so, <button>Copy</button>always.</p></article>") == "Let x=1 be so, always."
    assert html_extract.extract("<article><p>One <svg><title>icon</title></svg>two &lt;three&gt;, a &lt; b.</p><textarea>four</textarea></article>") == "One two <three>, a < b."
    assert html_extract.extract("<head><title>t</title><p>No body tag was there at all.") == "No body tag was there at all."


class _Article(HTMLParser):
    def __init__(self):
        super().__init__()
        self.blocks, self.inside = [""], False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_query_gives_every_article_of_the_table(spark):
    want = {}
    table = pq.read_table(f"{FOLDER}/pages.parquet").to_pydict()
    for page_id, html in zip(table["page_id"], table["html"], strict=True):
        parser = _Article()
        parser.feed(html or "")
        want[page_id] = "\n\n".join(t for b in parser.blocks if (t := " ".join(b.split())))
    rows = queries.QUERIES["op1_html_extract"](spark, FOLDER).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
