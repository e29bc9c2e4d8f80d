"""Shared pieces of the training-data operators.

Nothing here keeps state on the driver beyond paths and counts; tables that
cut lineage are written to the folder that the session names in
``spark.checkpoint.dir`` so that any executor can read them again.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many groups count as hot, so a broadcast of them is bounded.
MAX_HOT_GROUPS = 10_000
#: A group below this many rows is never hot.
MIN_HOT_ROWS = 128

#: Rows, and bytes, of an Arrow batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

_own_dirs: dict[str, str] = {}
_kept: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="weft-shared-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/weft/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """Text with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key``, safe for hot keys.

    A key with more than ``max(MIN_HOT_ROWS, total / MAX_HOT_GROUPS)`` rows is hot;
    there are at most ``MAX_HOT_GROUPS`` of these, so they are broadcast and their rows
    stay where they are. All other keys are shuffled. Null keys match nothing.
    """
    limit = max(MIN_HOT_ROWS, total // MAX_HOT_GROUPS)
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of texts at once, by rows and by bytes, alike for all operators."""
    for name, value in BATCH.items():
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)


def kept_cache(cached):
    """Mark a cached function as one whose values a worker may give up when it goes on to another operator."""
    _kept.append(cached)
    return cached


def drop_caches() -> None:
    """Give up what other operators kept in this Python worker."""
    for cached in _kept:
        if cached.cache_info().currsize:
            cached.cache_clear()
            release_memory()


def release_memory() -> None:
    """Give back what a Python worker no longer uses; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
