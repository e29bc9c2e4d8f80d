"""Secret scans: base spans against a matcher without regular expressions, the lexer's forms, linear time."""

import string
import time
from hashlib import sha256

import pyarrow.parquet as pq
import pytest

pytest.importorskip("weftgraph.llm")

from weftgraph.llm import queries, secrets  # noqa: E402

LONG = "Ab3$" * 2500
FORMS = [
    (f'client_credential = "{LONG}"', [LONG]),
    (f"client_credential = {LONG}", [LONG]),
    (r'db_pwd = "Xy9$kLm\\2Qw8z"', [r"Xy9$kLm\\2Qw8z"]),
    (r"""'signing_key' : 'q\'7Zk"x_9Lm2'""", [r"""q\'7Zk"x_9Lm2"""]),
    (r'line = "a\\b db_pwd=Xy9$kLm2Qw8z"', ["Xy9$kLm2Qw8z"]),
    ('db_pwd = "Xy9$" + "kLm2Qw8z"', ["Xy9$", "kLm2Qw8z"]),
    ('db_pwd = b\nb = "Xy9$kLm2Qw8z"', ["Xy9$kLm2Qw8z"]),
    ("db_pwd: |\n  Xy9$kLm2\n  Qw8zTT\nother: 1", ["Xy9$kLm2\n  Qw8zTT"]),
    ("<password>Xy9$kLm2Qw8z</password>", ["Xy9$kLm2Qw8z"]),
    ('dbPwd = "correct horse battery 9 staple"', ["correct horse battery 9 staple"]),
    ("author: John.Smith2020!", []),
    ('a = "Xy9$kLm2Qw8z"\nb = a\ndb_pwd = b\n', ["Xy9$kLm2Qw8z"]),
    ('a = "Xy9$"\nb = a + "kLm2"\ndb_pwd = b + "Qw8z"\n', ["Xy9$", "kLm2", "Qw8z"]),
    ("export MY_PWD=Xy9$kLm2Qw8z", ["Xy9$kLm2Qw8z"]),
    ('{"accessKey": "Xy9$kLm2Qw8z"}', ["Xy9$kLm2Qw8z"]),
    ('pwd = os.environ["HOME_DIR_12"]', []),
    ("CRED_PASS=<<EOF\nXy9$kLm2Qw8z\nEOF\n", ["Xy9$kLm2Qw8z"]),
    ('x = "ab\\nXy9$kL" # don\'t\ndb_pwd = x', ["ab\\nXy9$kL"]),
    ('db_pwd = "${HOME}/abc1234"', []),
    ('pwd = """Xy9$kLm2\nQw8z"""', ["Xy9$kLm2\nQw8z"]),
    ("don't tell: pwd='Xy9$kLm2Qw8z' it's", ["Xy9$kLm2Qw8z"]),
    ("a = b\nb = a\npwd = a", []),
    ("https://h.x/?auth=Xy9$kLm2Qw8z", ["Xy9$kLm2Qw8z"]),
    ("if pwd == 'Xy9$kLm2Qw8z':", []),
]


@pytest.mark.parametrize(("text", "want"), FORMS)
def test_forms(text, want):
    spans = secrets.scan(text)
    assert [text[a:b] for k, a, b in spans if k == "literal"] == want
    assert [s for s in spans if s[0] != "literal"] == brute(text)


UNITS = ["a=", "token=", '"', "\\\"", "'\"", 'pwd="a', "a = b\n", "<a>", "`", "pwd=pwd\n", "pwd: |\n", "<<EOF\n", '"""', 'pwd = "x" + ', "a.b=", "pwd:", "pwd = a\na = pwd\n", "\\"]


@pytest.mark.parametrize("unit", UNITS)
def test_linear_time(unit):
    began = time.perf_counter()
    secrets.scan("pwd " + unit * (200_000 // len(unit)))
    assert time.perf_counter() - began < 20


WORD, VALUE = ["password", "passwd", "secret", "token", "apikey", "api_key"], set(string.ascii_letters + string.digits + "+/_.=-")


def brute(text):
    """The base spans of the contract, character by character."""
    out = []
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)

    def run(at, allowed):
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    def assign(at):
        for word in WORD:
            if lower.startswith(word, at):
                for quoted in (1, 0):
                    i = at + len(word)
                    if quoted and text[i : i + 1] not in ("'", '"'):
                        continue
                    i = run(i + quoted, " ")
                    if text[i : i + 1] not in ("=", ":"):
                        continue
                    i = run(i + 1, " ")
                    for q in (1, 0):
                        if q and text[i : i + 1] not in ("'", '"'):
                            continue
                        end = run(i + q, VALUE)
                        if end > i + q:
                            return end, end - i - q
        return None

    at = 0
    while at < len(text):
        if found := assign(at):
            if found[1] >= 8:
                out.append((at, 0, found[0]))
            at = found[0]
        else:
            at += 1
    for kind, (head, allowed, least) in enumerate([("AKIA", string.ascii_uppercase + string.digits, 16), ("", "0123456789abcdef", 32)], 1):
        at = 0
        while at < len(text):
            end = run(at + len(head), allowed) if text.startswith(head, at) else at
            if end > at + len(head):
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    table = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    texts = dict(zip(table["doc_id"], table["text"], strict=True))
    rows = queries.QUERIES["op7_secret_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("literal")] == [f"{k}:{a}:{b}" for k, a, b in base]
    assert sum(r.n_assign for r in rows) > 0


def test_empty_texts():
    assert secrets.scan(None) == secrets.scan("") == secrets.scan("plain words only") == []
