"""File sources by extension, a registry for more, and JSON sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def reader(*extensions: str):
    """Register a reader for file extensions; a later one replaces an earlier one."""

    def register(fn: Reader) -> Reader:
        for e in extensions:
            _READERS[e.lower()] = fn
        return fn

    return register


def read(spark: SparkSession, path: str, using: str | None = None) -> DataFrame:
    """Read by the extension of ``path``, or as ``using`` names."""
    kind = (using or path.rstrip("/").rpartition(".")[2]).lower()
    if kind not in _READERS:
        raise ValueError(f"no reader for {kind!r}; there are {', '.join(sorted(_READERS))}")
    return _READERS[kind](spark, path)


@reader("txt", "md", "markdown", "text")
def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole files."""
    return spark.read.text(path, wholetext=True).select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))


@reader("html", "htm")
def stripped_html(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` without markup, by expressions."""
    files = whole_text(spark, path)
    bare = F.regexp_replace("text", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return files.withColumn("text", F.trim(F.regexp_replace(bare, r"\s+", " ")))


@reader("csv")
def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, inferSchema=True)


@reader("json", "jsonl")
def json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


@reader("parquet")
def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@reader("orc")
def orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


@reader("binary", "pdf", "png", "jpg", "wav")
def binary(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content``; decoding is left to a reader that the user registers."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def to_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
