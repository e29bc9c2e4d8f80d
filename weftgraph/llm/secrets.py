"""Secret scans by assignment-aware lexing.

Three base patterns are matched in every text. Beside these, source and configuration
syntax is lexed: strings with escapes, triple quotes, heredocs, YAML blocks, tagged values,
names and assignment operators. That gives name-literal pairs; literals may be joined
(``"x" + "y"``), and constants are propagated through names, defined before or after.
A literal whose target name is sensitive and whose form looks random scores as a secret.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

_TOKEN = re.compile(
    r"""(?P<triple>\"{3}|'{3})"""
    r"""|(?P<string>(?<![A-Za-z0-9_\\])(?:[rbufRBUF]{1,2}(?=["']))?(?:"(?:[^"\\\n]|\\(?s:.))*+"|'(?:[^'\\\n]|\\(?s:.))*+'|`(?:[^`\\\n]|\\(?s:.))*+`))"""
    r"""|<(?P<tag>[A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>(?P<inner>[^<>\n]++)</(?P=tag)>"""
    r"""|<<[-~]?["']?(?P<mark>[A-Za-z_][A-Za-z0-9_]*+)["']?(?=[^\n]*+\n)"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_$.-]*+)"""
    r"""|(?P<op>:=|=>|[=!<>+*/|&^%-]=+|::|[=:])"""
    r"""|\s++|[^\S\s]|[^A-Za-z_\s"'`<=:]"""
)
_ASSIGNS = frozenset(["=", ":", ":=", "=>"])
_GAP = re.compile(r"[\x20\t]*+")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]++")
_JOIN = re.compile(r"[\x20\t]*+(?:\\\r?\n)?[\x20\t]*+(?:(?:\+|\.\.?|&)\s*+)?")
_BLOCK = re.compile(r"[|>][-+0-9]*+[\x20\t]*+\r?\n")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.\x20-]*\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(?s:(.)))")
_PLACEHOLDER = re.compile(r"\$[{(]|\{\{|%[({]|<[^>]*>\Z|\[[^\]]*\]\Z")
#: A text without one of these has no sensitive name.
_HINT = re.compile(r"pass|pwd|secret|token|key|auth|credential|bearer")

#: Words of names that are sensitive alone, and those that are so before ``key``.
SENSITIVE = frozenset("password passwords passwd passphrase passphrases pwd pass secret secrets token tokens auth credential credentials bearer apikey apikeys accesskey privatekey secretkey authtoken".split())
KEYS = frozenset("api access private secret encryption signing master ssh account auth".split())
#: Least score of a literal, and its least length.
SCORE = 1.5
LENGTH = 8
#: A quoted key or a reference is shorter than this; names and literals have no bound.
KEY_LENGTH = 1_000


def name_score(name: str) -> float:
    """1 for a name with a sensitive word (camel case, underscores, dashes, dots and digits part words), else 0."""
    words = [w.lower() for w in _PARTS.findall(name)]
    return float(any(w in SENSITIVE for w in words) or any(a in KEYS and b in ("key", "keys") for a, b in zip(words, words[1:], strict=False)))


def _score(counts: Counter, size: int) -> float:
    if size < LENGTH:
        return 0.0
    entropy = -sum(c / size * math.log2(c / size) for c in counts.values())
    classes = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    return min(1.0, entropy / 5 + (classes - 1) * 0.15)


def literal_score(text: str) -> float:
    """0 to 1: entropy of the characters, and their mix of classes; 0 for a short one and for a reference in place of a value."""
    return 0.0 if _PLACEHOLDER.match(text) else _score(Counter(text), len(text))


class _Pair:
    """A name, where it is, and its value: literal spans, and names in place of literals."""

    __slots__ = ("name", "at", "parts", "quoted")

    def __init__(self, name: str, at: int, parts: list[tuple[int, int] | str], quoted: bool) -> None:
        self.name, self.at, self.parts, self.quoted = name, at, parts, quoted


def _string_of(m: re.Match) -> tuple[int, int]:
    """Span of the content of a string token."""
    end = m.end("string") - 1
    return m.string.index(m.string[end], m.start("string")) + 1, end


def _block(text: str, key: int, start: int, last: int) -> tuple[int, int] | None:
    """The lines from ``start`` on that are indented more than the line of the key."""
    line = text.rfind("\n", 0, key) + 1
    indent = _GAP.match(text, line).end() - line
    first, end, at = -1, -1, start
    while at < last:
        stop = text.find("\n", at, last)
        stop = last if stop < 0 else stop
        begins = _GAP.match(text, at, stop).end()
        if begins < stop and begins - at <= indent:
            break
        if begins < stop:
            first, end = begins if first < 0 else first, stop
        at = stop + 1
    return (first, end) if first >= 0 else None


def _value(text: str, key: int, at: int, op: str, last: int, bare_end: int) -> tuple[list[tuple[int, int] | str], bool, int]:
    """Parts of the value at ``at``, whether it is quoted, and where the last run of bare characters ends."""
    at = _GAP.match(text, at, last).end()
    if at >= last:
        return [], False, bare_end
    if text[at] in "|>" and op == ":" and (m := _BLOCK.match(text, at, last)):
        span = _block(text, key, m.end(), last)
        return ([span] if span else []), True, bare_end
    parts: list[tuple[int, int] | str] = []
    while m := _TOKEN.match(text, at, last):
        if m["string"]:
            parts.append(_string_of(m))
        elif m["triple"]:
            end = text.find(m["triple"], m.end(), last)
            if end < 0:
                break
            parts.append((m.end(), end))
            at = _JOIN.match(text, end + 3, last).end()
            continue
        elif m["mark"]:
            start = text.find("\n", m.end(), last) + 1
            close = re.compile(rf"^[\x20\t]*{m['mark']}\b", re.M).search(text, start, last)
            if start and close and close.start() > start:
                parts.append((start, close.start() - 1))
            break
        elif m["name"] and parts and _IDENTIFIER.match(m["name"]):
            parts.append(m["name"])
        else:
            break
        joined = _JOIN.match(text, m.end(), last).end()
        # names are joined by an operator only
        if m["name"] and joined == _GAP.match(text, m.end(), last).end():
            break
        at = joined
    if parts:
        while isinstance(parts[-1], str) and text[at - 1].isspace() and len(parts) > 1 and not _joins(text, at):
            parts.pop()
        return parts, True, bare_end
    # a run that begins inside the last one ends with it
    end = bare_end if at < bare_end else (m.end() if (m := _BARE.match(text, at, last)) else at)
    if end == at:
        return [], False, bare_end
    if _IDENTIFIER.match(text, at, end) and end < last and text[end] in "([":
        return [], False, end
    joined = _JOIN.match(text, end, last).end()
    if _IDENTIFIER.match(text, at, end) and joined > _GAP.match(text, end, last).end() and (m := _TOKEN.match(text, joined, last)) and m["string"]:
        return [text[at:end], _string_of(m)], True, end
    return [(at, end)], False, end


def _joins(text: str, at: int) -> bool:
    while at and text[at - 1].isspace():
        at -= 1
    return text[at - 1 : at] in ("+", ".", "&")


def pairs(text: str) -> list[_Pair]:
    """Names and their values in text order; pairs inside a string follow those of the string."""
    out: list[_Pair] = []
    todo = [(0, len(text))]
    while todo:
        first, last = todo.pop()
        key: tuple[str, int] | None = None
        bare_end = 0
        at = first
        while at < last and (m := _TOKEN.match(text, at, last)):
            at = m.end()
            if m["string"]:
                start, end = _string_of(m)
                key = (text[start:end], m.start()) if end - start < KEY_LENGTH and _KEY.match(text, start, end) else None
                if end - start >= LENGTH and (first, last) != (start, end):
                    todo.append((start, end))
            elif m["triple"]:
                end = text.find(m["triple"], at, last)
                if end >= 0:
                    todo.append((at, end))
                    at = end + 3
                key = None
            elif m["tag"]:
                out.append(_Pair(m["tag"], m.start(), [m.span("inner")], True))
                key = None
            elif m["name"]:
                key = m["name"], m.start()
            elif m["op"] and key and m["op"] in _ASSIGNS:
                parts, quoted, bare_end = _value(text, key[1], at, m["op"], last, bare_end)
                if parts:
                    out.append(_Pair(key[0].rpartition(" ")[2] if key[0][-1:] != " " else key[0].strip(), key[1], parts, quoted))
                key = None
            elif not m[0].isspace() or "\n" in m[0]:
                key = None
        # a character that begins no token
        if at < last:
            todo.append((at + 1, last))
    return sorted(out, key=lambda p: (p.at, p.parts[0] if isinstance(p.parts[0], tuple) else (0, 0)))


def _decoded(literal: str) -> str:
    plain = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else plain.get(m[3], m[3]), literal) if "\\" in literal else literal


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, by propagating constants.

    A name stands for its last definition before the use, or else for the first one after it.
    """
    found = pairs(text)
    defined: dict[str, list[int]] = {}
    for k, pair in enumerate(found):
        defined.setdefault(pair.name, []).append(k)

    def uses(k: int) -> list[int | tuple[int, int]]:
        """Parts of definition ``k``: literals, and definitions that names stand for."""
        out: list[int | tuple[int, int]] = []
        for part in found[k].parts:
            name = part
            if isinstance(part, tuple):
                name = text[part[0] : part[1]] if not found[k].quoted and part[1] - part[0] < KEY_LENGTH else ""
                if not (_IDENTIFIER.match(name) and any(d != k for d in defined.get(name, ()))):
                    out.append(part)
                    continue
            of = defined.get(name, [])
            at = bisect_left(of, k)
            out += of[at - 1 : at] if at else [d for d in of[at : at + 2] if d != k][:1]
        return out

    # for each definition its parts, the counts of its characters, and whether a quoted literal is among them
    known: dict[int, tuple[list, Counter, bool]] = {}

    def know(first: int) -> None:
        open_, path = {first}, [(first, parts := uses(first), iter(parts))]
        while path:
            k, parts, rest = path[-1]
            part = next(rest, None)
            if part is None:
                counts, quoted = Counter(), False
                for p in parts:
                    if isinstance(p, tuple):
                        literal = _decoded(text[p[0] : p[1]])
                        counts.update("" if _PLACEHOLDER.match(literal) else literal)
                        quoted |= found[k].quoted
                    elif p in known:
                        counts.update(known[p][1])
                        quoted |= known[p][2]
                known[k] = parts, counts, quoted
                open_.discard(k)
                path.pop()
            elif isinstance(part, int) and part not in known and part not in open_:
                open_.add(part)
                path.append((part, parts := uses(part), iter(parts)))

    told, todo = 0, []
    for k, pair in enumerate(found):
        # a value inside the bare run of a sensitive name is part of that
        if not name_score(pair.name) or (not pair.quoted and pair.parts[0][0] < told):
            continue
        if not pair.quoted:
            told = pair.parts[0][1]
        if k not in known:
            know(k)
        _, counts, quoted = known[k]
        if (quoted or not any(map(str.isspace, counts))) and name_score(pair.name) + _score(counts, counts.total()) >= SCORE:
            todo.append(k)
    spans, seen = set(), set(todo)
    while todo:
        for part in known[todo.pop()][0]:
            if isinstance(part, tuple):
                spans.add(part)
            elif part not in seen and part in known:
                seen.add(part)
                todo.append(part)
    return sorted(spans)


def _keyed(low: str) -> bool:
    return "pass" in low or "token" in low or "secret" in low or "key" in low


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """Kind, start, end (code points, end exclusive) of all spans, ordered by start and then by ``KINDS``.

    Base spans are leftmost and don't overlap within a kind; a match that is too short still
    takes its place. None of them is left out for a span of another kind.
    """
    text = text or ""
    out = [("hex", *m.span()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if "=" in text or ":" in text or "</" in text:
        if _keyed(low := text.lower()):
            out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LENGTH]
        if _HINT.search(low):
            out += [("literal", *span) for span in literals(text)]
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], rank[s[0]], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t.as_py()) for t in batch.column(1)]
        count = lambda kind: pa.array([sum(s[0] == kind for s in r) for r in rows], pa.int64())
        base = [_joined([s for s in r if s[0] != "literal"]) for r in rows]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0),
                "n_assign": count("assign"),
                "n_access": count("access"),
                "n_hex": count("hex"),
                "base_sha256": pa.array([sha256(b.encode()).hexdigest() for b in base], pa.string()),
                "spans": pa.array(map(_joined, rows), pa.string()),
            }
        )


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null counts as empty, which has no spans. A null id stays null; repeated rows give repeated
    results; an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scanned, schema)
