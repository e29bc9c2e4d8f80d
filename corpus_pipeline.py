"""A training-corpus pipeline over ``documents``, each stage on all that the one before kept.

Language ID rejects texts of no language, exact and near-duplicate stages leave one document of each group,
mixing repeats the smaller sources towards flatter weights, and SentencePiece encodes what is left.

Every stage takes empty tables (and returns one), nulls in any column, repeated rows and columns beside those of
``documents``; what happens to these is said at each stage. Whole texts are used, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import exact_dedup, language_id, mixing, order_minhash, sentencepiece_bpe
from weftgraph.llm.common import documents, materialise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and texts of which known languages explain less than half.

    Texts in several known languages stay. Rows with a null id or label are judged like others but teach nothing.
    """
    return language_id.reject(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, that with the largest doc_id; another text under a dropped row's id stays."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least doc_id of each class of near copies; rows without an id stay."""
    found = order_minhash.near_duplicates(docs)
    lost = materialise(found.filter(~found.kept & found.doc_id.isNotNull()).select("doc_id"), "lost")
    return exact_dedup.drop_ids(docs, lost, lost.count())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of smaller sources up to twice; a null source is one of its own, a null text has no tokens."""
    return mixing.mixed_documents(docs, max_repetition=2.0)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document given by the mixture; a null text is encoded as an empty one."""
    return sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Language models, Order MinHash and the tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
