"""Chat formatting by schema fingerprints.

The nested field paths of a record are hashed; the hash selects a declarative mapping that
turns its layout (prompt and answer, instruction, messages, one row a turn, ...) into
canonical turns. Turns are written in a marked template in which control strings inside
texts are escaped reversibly, with the loss mask as spans of the assistants' texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|n|>"
ASSISTANT = "assistant"
#: A formatted part ends at the first turn beyond this many characters, so no row grows with its conversation.
PART_CHARS = 1 << 20
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")

ROLES = {"human": "user", "prompter": "user", "gpt": ASSISTANT, "model": ASSISTANT, "bot": ASSISTANT, "chatgpt": ASSISTANT, "ai": ASSISTANT}


@dataclass(frozen=True)
class Layout:
    """``turns`` names a list of records with ``role`` and ``text``; else ``fields`` gives role and field pairs in order.

    A layout with ``order`` has one row a turn, of the conversation that ``group`` names.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())
    group: str = ""
    order: str = ""

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def paths_of(value: Any, prefix: str = "") -> set[str]:
    """Nested field paths; ``[]`` stands for the elements of a list."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(paths_of(v, prefix + "[]") for v in value)) if value else {prefix + "[]"}
    return {prefix}


def _fields(name: str, *pairs: tuple[str, str]) -> Layout:
    return Layout(name, tuple(p for _, f in pairs for p in f.split("+")), fields=tuple((r, tuple(f.split("+"))) for r, f in pairs))


LAYOUTS = [
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("dialogue", ("dialogue[].speaker", "dialogue[].text"), "dialogue", "speaker", "text"),
    Layout("turn rows", ("conv_id", "turn", "role", "text"), role="role", text="text", group="conv_id", order="turn"),
    _fields("prompt response", ("user", "prompt"), (ASSISTANT, "response")),
    _fields("prompt completion", ("user", "prompt"), (ASSISTANT, "completion")),
    _fields("question answer", ("user", "question"), (ASSISTANT, "answer")),
    _fields("instruction", ("user", "instruction"), (ASSISTANT, "output")),
    _fields("instruction input", ("user", "instruction+input"), (ASSISTANT, "output")),
    _fields("system prompt response", ("system", "system"), ("user", "prompt"), (ASSISTANT, "response")),
    _fields("nested pair", ("user", "data.prompt"), (ASSISTANT, "data.response")),
]
BY_FINGERPRINT = {layout.fingerprint: layout for layout in LAYOUTS}


def layout_for(paths: set[str], rows: bool = False) -> Layout | None:
    """The layout with the fingerprint of these paths; else the one with most of its paths among them, so extra fields don't matter.

    ``rows`` asks for layouts of one row a turn; other layouts are of one record a conversation.
    """
    found = BY_FINGERPRINT.get(fingerprint(paths))
    if found and bool(found.order) == rows:
        return found
    fitting = [layout for layout in LAYOUTS if bool(layout.order) == rows and paths.issuperset(layout.paths)]
    return max(fitting, key=lambda layout: len(layout.paths), default=None)


def _at(record: Any, path: str) -> Any:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _string(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_role(role: Any) -> str:
    role = _string(role)
    return ROLES.get(role.lower(), role)


def turns_of(record: dict) -> tuple[str, list[tuple[str, str]]]:
    """Layout name and canonical (role, text) turns; an unknown layout has an empty name and no turns."""
    layout = layout_for(paths_of(record))
    if layout is None:
        return "", []
    if layout.turns:
        return layout.name, [(canonical_role(t.get(layout.role)), _string(t.get(layout.text))) for t in _at(record, layout.turns) or []]
    return layout.name, [(role, "\n".join(x for x in (_string(_at(record, p)) for p in paths) if x)) for role, paths in layout.fields]


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    head = f"{START}{escape(role).replace('\n', NEWLINE)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text, unescaped."""
    out = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        body, end, _ = rest.rpartition(END)
        if not end:
            raise ValueError("a turn without an end")
        out.append((unescape(role.replace(NEWLINE, "\n")), unescape(body)))
    return out


_FORMATTED = "conv_id long, part long, layout string, formatted string, starts array<long>, ends array<long>"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("layout", pa.string()), ("formatted", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


class _Parts:
    def __init__(self) -> None:
        self.rows: list[dict] = []

    def open(self, conv_id: int | None, layout: str, part: int = 0) -> None:
        self.conv_id, self.layout, self.part = conv_id, layout, part
        self.pieces: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.size = 0

    def add(self, role: str, text: str) -> None:
        if self.size >= PART_CHARS:
            self.close()
            self.open(self.conv_id, self.layout, self.part + 1)
        piece, a, b = format_turn(role, text)
        if role == ASSISTANT:
            self.starts.append(self.size + a)
            self.ends.append(self.size + b)
        self.pieces.append(piece)
        self.size += len(piece)

    def close(self) -> None:
        self.rows.append({"conv_id": self.conv_id, "part": self.part, "layout": self.layout, "formatted": "".join(self.pieces), "starts": self.starts, "ends": self.ends})

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _format_rows(layout: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # partitions are ranges in order, so parts of one conversation in several are in order, too
        parts, current, begun, first = _Parts(), None, False, TaskContext.get().partitionId() << 32
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or conv_id != current:
                    if begun:
                        parts.close()
                    parts.open(conv_id, layout, first)
                    current, begun = conv_id, True
                parts.add(role, text)
            if parts.rows:
                yield parts.take()
        if begun:
            parts.close()
            yield parts.take()

    return run


def _format_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = _Parts()
        for conv_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                record = json.loads(text or "{}")
            except ValueError:
                record = {}
            layout, turns = turns_of(record if isinstance(record, dict) else {})
            parts.open(conv_id, layout)
            for role, body in turns:
                parts.add(role, body)
            parts.close()
        yield parts.take()


def format_records(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Format records of any known layouts, one JSON object a row: conv_id, part, layout, formatted, starts, ends.

    A null, broken or unknown record gives an empty text with an empty layout.
    """
    small_batches(records.sparkSession)
    return records.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(_format_json, _FORMATTED)


def format_turns(rows: DataFrame) -> DataFrame:
    """Format a table with one row a turn: conv_id, part, layout, formatted, starts, ends.

    The table's field paths select the layout. Turns are ordered by turn (null first), then role
    and text; null roles and texts are empty; repeated rows are repeated turns; null ids are one
    conversation. A long conversation may lie in several partitions; ``part`` numbers rise in its order.
    """
    small_batches(rows.sparkSession)
    layout = layout_for(set(rows.columns), rows=True)
    if layout is None:
        raise ValueError(f"no layout of one row a turn for the columns {sorted(rows.columns)}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(layout.group).cast("long").alias("conv_id"), F.col(layout.order).alias("turn"), text(layout.role).alias("role"), text(layout.text).alias("text"))
    dealt = turns.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format_rows(layout.name), _FORMATTED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    done: list[tuple] = []
    state = None

    def finish() -> None:
        if state:
            conv_id, n, turns, chars, loss, size = state
            done.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def take() -> pa.RecordBatch:
        nonlocal done
        rows, done = done, []
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != state[0]:
                finish()
                state = [row["conv_id"], 0, sha256(), 0, sha256(), 0]
            formatted = row["formatted"]
            for role, text in read_turns(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for a, b in zip(row["starts"], row["ends"], strict=True):
                loss = unescape(formatted[a:b])
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
            state[5] += len(formatted)
        yield take()
    finish()
    if done:
        yield take()


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from its formatted parts, in whatever order they are stored.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A digest has to read a conversation from
    its start, so one task streams it, a part at a time.
    """
    parts = formatted.drop("layout").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
