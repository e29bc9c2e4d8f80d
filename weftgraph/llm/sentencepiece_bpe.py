"""SentencePiece encoding and decoding for merge-type vocabularies.

``Encoder`` keeps an agenda (a heap) of adjacent symbol pairs that form a piece, ordered by
score and then by place, and merges the best until none is left. No piece of such a
vocabulary holds a meta space after another character, so no merge crosses the start of
a word; frequent words are encoded once and kept. In every batch all
words that were merged anew, and each ``CHECK_EVERY``-th whole text, are compared with the sentencepiece library, and
a difference is an error.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_cache, release_memory, small_batches

SPACE = "▁"
#: A worker keeps the first this many words it meets, and starts anew after as many misses; longer words aren't kept.
MAX_WORDS_KEPT = 600_000
MAX_MISSES = 4_000_000
MAX_WORD_KEPT = 48
CHECK_EVERY = 4
#: Texts that are encoded, compared and decoded in one step.
AT_ONCE = 32


class Encoder:
    """Encodes with the pieces and scores of a BPE model; ``crossing`` vocabularies take each text as one word."""

    def __init__(self, model_path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        m = self.library
        self.ids, self.order, self.bytes = {}, {}, {}
        for i in range(m.vocab_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[piece], self.order[piece] = i, -m.get_score(i)
        self.unknown, self.end = m.unk_id(), m.eos_id()
        self.crossing = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        self.breaks = not any("\n" in piece for piece in self.ids)
        self.words: dict[str, bytes] = {}
        self.misses = 0
        #: Words merged since the last check, and their ids.
        self.fresh: list[tuple[str, list[int]]] = []
        self.decimals = [str(i) for i in range(m.vocab_size())]
        self.split = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merge(self, word: str) -> list[int]:
        """Ids of one word by the agenda: pairs as (order, start, end), best score first and leftmost of equal ones."""
        n, order, push, pop = len(word), self.order.get, heapq.heappush, heapq.heappop
        agenda = [(x, i, i + 2) for i in range(n - 1) if (x := order(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        # where the symbol that starts here ends (0: none does), and where the one that ends here starts
        ends, starts = list(range(1, n + 1)), list(range(-1, n))
        while agenda:
            _, i, e = pop(agenda)
            m = ends[i]
            # stale if start and end no longer hold just two symbols
            if not 0 < m < e or ends[m] != e:
                continue
            ends[i], ends[m], starts[e] = e, 0, i
            if e < n and (x := order(word[i : (k := ends[e])])) is not None:
                push(agenda, (x, i, k))
            if i and (x := order(word[(h := starts[i]) : e])) is not None:
                push(agenda, (x, h, e))
        out: list[int] = []
        i, known = 0, self.ids.get
        while i < n:
            s = word[i : ends[i]]
            i = ends[i]
            if (found := known(s)) is not None:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode("utf-8"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def word(self, key: str) -> bytes:
        """Ids of one word as 32-bit integers; a key is a word without its meta space, or begins with a line break."""
        ids = self.merge(key if key.startswith("\n") and self.breaks else SPACE + key)
        self.fresh.append((key, ids))
        found = array("i", ids).tobytes()
        self.misses += 1
        if self.misses > MAX_MISSES:
            self.words.clear()
            self.misses = 0
        if len(self.words) < MAX_WORDS_KEPT and len(key) <= MAX_WORD_KEPT:
            self.words[key] = found
        return found

    def check(self) -> None:
        """Compare the words merged since the last check with the library, which sets a meta space before each."""
        # a word that begins with a line break or a meta space, or is empty, occurs after another one only
        fresh = [(k, ids) for k, ids in self.fresh if k and k[0] not in (SPACE, "\n")] if self.breaks and not self.crossing else []
        self.fresh = []
        for (key, ids), want in zip(fresh, self.library.encode([k for k, _ in fresh], num_threads=1), strict=True):
            if ids != want:
                raise ValueError(f"the library encodes the word {key!r} otherwise")

    def keys(self, text: str) -> list[str]:
        if self.crossing or not self.breaks or "  " in text or text[0] == " " or SPACE in text:
            whole = SPACE + text.replace(" ", SPACE)
            words = [whole] if self.crossing else self.split.findall(whole)
            if not self.breaks:
                return [w[1:] for w in words]
            # a line break is in no piece, so it begins a word of its own
            return [k for w in words for k in w[1:].replace("\n", " \n").split(" ")]
        return text.replace("\n", " \n").split(" ")

    def encode(self, text: str) -> list[int]:
        """All ids of ``text``, with the end id."""
        if not text:
            return [self.end]
        kept, miss = self.words.get, self.word
        ids = np.frombuffer(b"".join([kept(k) or miss(k) for k in self.keys(text)]), np.int32).tolist()
        ids.append(self.end)
        return ids


@kept_cache
@lru_cache(maxsize=2)
def encoder_of(model_path: str) -> Encoder:
    """One encoder a process, so that its words outlive a task."""
    return Encoder(model_path)


def _sha(text: str) -> str:
    return sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _encoded(encoder: Encoder, batch: pa.RecordBatch, with_ids: bool, check_every: int, first: int) -> pa.RecordBatch:
    """Rows of the result; of the texts, that at ``first`` and each ``check_every``-th after it are compared with the library."""
    library = encoder.library
    texts = [t or "" for t in batch.column(1).to_pylist()]
    ids = [encoder.encode(t) for t in texts]
    encoder.check()
    expected = library.encode(texts[first::check_every], add_eos=True, num_threads=1)
    if ids[first::check_every] != expected:
        wrong = next(i for i, want in enumerate(expected) if ids[first + i * check_every] != want)
        raise ValueError(f"the library encodes the text of id {batch.column(0)[first + wrong * check_every]} otherwise")
    decimals = encoder.decimals.__getitem__
    decoded = library.decode(ids, num_threads=1)
    columns = {
        "doc_id": batch.column(0),
        "n_tokens": pa.array(map(len, ids), pa.int64()),
        "ids_sha256": pa.array([sha256(" ".join(map(decimals, x)).encode()).hexdigest() for x in ids], pa.string()),
        "decoded_sha256": pa.array(map(_sha, decoded), pa.string()),
    }
    if with_ids:
        columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
    return pa.RecordBatch.from_pydict(columns)


def _run(model_path: str, with_ids: bool, check_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        for batch in batches:
            # the ids and words of a few texts at once, as they take many times the room of the texts
            for start in range(0, batch.num_rows, AT_ONCE):
                yield _encoded(encoder, batch.slice(start, AT_ONCE), with_ids, check_every, -start % check_every)
        release_memory()

    return run


def encode(docs: DataFrame, model_path: str, with_ids: bool = False, check_every: int = CHECK_EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` and ``decoded`` if asked for.

    The whole text is encoded with an end id only; null counts as empty and gives the end id
    alone. A null id stays null; repeated rows give repeated results; other columns are
    not read. The model file must be at ``model_path`` on every executor.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run(model_path, with_ids, check_every), schema)
