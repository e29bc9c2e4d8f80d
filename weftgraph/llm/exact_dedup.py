"""Exact deduplication: two passes with a Bloom filter.

Pass one hashes every normalised text and finds the filter positions that two rows
or more set. Pass two probes it: a row that misses the filter is unique and passes
straight through; only possible repeats shuffle, as (id, digest) without the text.
All of it is DataFrame functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import free_name, join_groups, materialise, text_of


def _sha256(text_col: str) -> Column:
    normal = F.translate(text_of(text_col), string.ascii_uppercase, string.ascii_lowercase)
    return F.sha2(normal.cast("binary"), 256)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z only; null counts as empty, and
    all empty texts are one group. The largest id of a group stays. A null id loses
    against any other; if a group has only null ids, all its rows count as kept. Repeated
    rows with one id and text are each counted in ``group_size`` and share ``kept``.
    An empty table gives an empty result; other columns are not read.
    """
    keys = materialise(docs.select(F.col(id_col).alias("doc_id"), F.unhex(_sha256(text_col)).alias("digest")), "digests")
    total = keys.count()
    n_blocks = bloom.blocks_for(total)
    twice = bloom.build(keys, "digest", n_blocks, at_least=2)
    probed = bloom.probe(keys, F.col("digest"), twice, n_blocks)
    marked = materialise(probed, "marked")
    single = marked.filter(~F.col("__maybe")).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    repeats = marked.filter("__maybe").select("doc_id", "digest")
    groups = materialise(
        repeats.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    joined = join_groups(repeats, groups, "digest", "group_size", total)
    return single.unionByName(joined.select("doc_id", "digest", "keep_id", "group_size")).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_ids(docs: DataFrame, ids: DataFrame, n_ids: int, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (one column, the same name).

    A bounded Bloom filter of the ids lets nearly all other rows pass without a
    shuffle; only possible matches meet the exact list. Rows with a null id stay.
    """
    n_blocks = bloom.blocks_for(n_ids)
    maybe = free_name(docs, "__maybe")
    seen = bloom.probe(docs, F.col(id_col), bloom.build(ids, id_col, n_blocks), n_blocks, maybe)
    passed = seen.filter(~F.col(maybe)).drop(maybe)
    doubtful = seen.filter(F.col(maybe)).drop(maybe)
    return passed.unionByName(doubtful.join(ids.distinct(), id_col, "left_anti").select(passed.columns))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per distinct normalised text, all columns kept.

    The row with the largest id stays; where several rows have this id (or none has an id), one of them, which may be
    any if their other columns differ. Another text under the id of a dropped one isn't touched. A bounded
    Bloom filter of the ids concerned lets nearly all other rows pass without a shuffle or a second digest.
    """
    found = classify(docs, id_col, text_col).filter("group_size > 1")
    rows = found.groupBy("doc_id", "text_sha256", "kept").agg(F.count(F.lit(1)).alias("n")).filter("not kept or n > 1")
    rows = materialise(rows.select("doc_id", "text_sha256", "kept"), "lost")
    ids = rows.select("doc_id").distinct()
    n_blocks = bloom.blocks_for(rows.count())
    maybe, digest = free_name(docs, "__maybe"), free_name(docs, "__digest")
    seen = bloom.probe(docs, F.col(id_col), bloom.build(ids, "doc_id", n_blocks), n_blocks, maybe)
    passed = seen.filter(~F.col(maybe)).drop(maybe)
    doubtful = seen.filter(F.col(maybe)).drop(maybe).withColumn(digest, _sha256(text_col)).alias("d")
    lost = rows.filter(~F.col("kept")).select("doc_id", "text_sha256").alias("l")
    rest = doubtful.join(lost, F.col(f"d.`{id_col}`").eqNullSafe(F.col("l.doc_id")) & (F.col(f"d.`{digest}`") == F.col("l.text_sha256")), "left_anti")
    return passed.unionByName(rest.dropDuplicates([digest]).select(passed.columns))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
), g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
