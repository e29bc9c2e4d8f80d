"""Embedding texts: the default embedder needs no model and no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[str], list[float]]
DIMS = 256


def hashed_ngrams(text: str, dims: int = DIMS) -> list[float]:
    """A unit vector of hashed words and letter trigrams; all zero for a text without words."""
    v = np.zeros(dims)
    for word in regex.findall(r"[\p{L}\p{N}_]+", text.lower()):
        marked = f"<{word}>"
        for gram in (word, *(marked[i : i + 3] for i in range(len(marked) - 2))):
            h = xxhash.xxh64_intdigest(gram)
            v[h % dims] += 1.0 if h >> 63 else -1.0
    size = float(np.linalg.norm(v))
    return (v / size if size else v).tolist()


def embedded(texts: DataFrame, embed: Embedder, text_col: str = "text") -> DataFrame:
    """``id, embedding`` of the rows of ``texts`` (id and a text), in Arrow batches; a null text has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [embed(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "embedding"])

    return texts.filter(F.col(text_col).isNotNull()).select("id", F.col(text_col).alias("text")).mapInArrow(run, "id string, embedding array<double>")
