"""Text functions: sentences, chunks, summaries, slugs and derived ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations after which a full stop doesn't end a sentence, in either case.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st ave blvd dept vol vs etc inc ltd co corp gov gen col sgt capt maj lt pvt "
    "jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun e.g i.e cf al approx no fig eq ref sec chap app"
).split()
_ABBREVIATED = re.compile(r"\b(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")\.$", re.I)
_INITIAL = re.compile(r"(?:^|\s)[A-Z]\.$")
#: Fixed value: where a sentence may end.
_BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'(\[])")


def split_sentences(text: str | None, shortest: int = 20) -> list[str]:
    """Sentences of a text; a text below ``shortest`` characters is one sentence, an empty one none."""
    text = (text or "").strip()
    if not text:
        return []
    if len(text) < shortest:
        return [text]
    out: list[str] = []
    for piece in _BOUNDARY.split(text):
        if out and (_ABBREVIATED.search(out[-1]) or (_INITIAL.search(out[-1]) and "A" <= piece[:1] <= "Z")):
            out[-1] += " " + piece
        else:
            out.append(piece)
    return [p.strip() for p in out if p.strip()]


def chunk_fixed(text: Column, size: int = 2000, overlap: int = 50) -> Column:
    """Windows of ``size`` characters, each beginning ``size - overlap`` after the last; explode the array for rows."""
    step = max(1, size - overlap)
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk_by_paragraph(text: str, largest: int = 2000) -> list[str]:
    """Paragraphs packed greedily up to ``largest`` characters, a pack being closed once it is half full and the next doesn't fit."""
    out: list[str] = []
    held = ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text or "")):
        if not p:
            continue
        if held and len(held) + 2 + len(p) > largest:
            out.append(held)
            held = ""
        while len(p) > largest:
            out.append(p[:largest])
            p = p[largest:]
        held = f"{held}\n\n{p}" if held else p
    return [*out, held] if held else out


def chunk_by_heading(text: str, largest: int = 2000) -> list[tuple[str, str]]:
    """(heading, body) for each heading of one to six marks; what is too long is cut into paragraphs."""
    out: list[tuple[str, str]] = []
    heading, body = "", []

    def close() -> None:
        whole = "\n".join(body).strip()
        if whole or heading:
            out.extend((heading, c) for c in (chunk_by_paragraph(whole, largest) or [""]))

    for line in (text or "").splitlines():
        if m := re.match(r"#{1,6}\s+(.*)", line):
            close()
            heading, body = m[1].strip(), []
        else:
            body.append(line)
    close()
    return out


def summary(text: Column, size: int = 200) -> Column:
    """The first ``size`` characters, cut at the last word, with dots."""
    head = F.regexp_replace(F.substring(text, 1, size), r"\s+\S*\z", "")
    return F.when(F.length(text) <= size, text).otherwise(F.concat(head, F.lit("...")))


def slug(text: Column) -> Column:
    """Lower case, other characters than letters and digits to ``_``; above 40 characters 33 of them and 6 of a digest."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+\z", "")
    return F.when(F.length(s) > 40, F.concat(F.substring(s, 1, 33), F.lit("_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 6))).otherwise(s)


def auto_id(kind: str, **fields: Column) -> Column:
    """The first 16 hex digits of the digest of the kind and the sorted fields."""
    parts = [F.lit(f"kind={kind}"), *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in sorted(fields.items())]]
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 16)
