"""Sharding by size-tiered compaction, with DataFrame functions only.

Arrivals are appended as runs of small immutable shards. Runs of similar size are merged,
tier by tier, into files of a target size; a merged run is written once, however many tiers
it climbs. A manifest version lists the runs that count and is committed by one rename that
fails where the version is there already, so a reader sees either the old version or the
new one, of two writers one loses, and a lost job leaves only files that no manifest
names, until ``vacuum`` deletes them.
"""

from __future__ import annotations

import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, new_path, text_of

FANOUT = 4
TARGET_BYTES = 128 << 20
_RUN = "run string, rows long, bytes long, files long"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, root: str) -> int:
    """The committed version, 0 if there is none."""
    at, fs = _path(spark, f"{root}/manifest")
    if not fs.exists(at):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), default=0)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The runs of the committed version: run, rows, bytes, files."""
    now = version(spark, root)
    return spark.read.schema(_RUN).parquet(f"{root}/manifest/v{now}") if now else spark.createDataFrame([], _RUN)


def commit(spark: SparkSession, root: str, runs: list[tuple[str, int, int, int]], base: int) -> int:
    """Make ``runs`` the version after ``base``; fails if another writer was first."""
    staged = f"{root}/staged/{uuid.uuid4().hex}"
    spark.createDataFrame(runs, _RUN).coalesce(1).write.parquet(staged)
    source, fs = _path(spark, staged)
    goal, _ = _path(spark, f"{root}/manifest/v{base + 1}")
    fs.mkdirs(goal.getParent())
    jvm = spark.sparkContext._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(source, goal, options)
    except Py4JJavaError as e:
        fs.delete(source, True)
        raise RuntimeError(f"version {base + 1} of {root} was committed by another writer") from e
    return base + 1


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete the runs that none of the last ``keep`` versions names, and older manifests; returns the runs deleted.

    Not to be called while another writer is between its runs and its commit.
    """
    now = version(spark, root)
    if not now:
        return []
    kept = {r.run for v in range(max(1, now - keep + 1), now + 1) for r in spark.read.schema(_RUN).parquet(f"{root}/manifest/v{v}").collect()}
    at, fs = _path(spark, f"{root}/runs")
    gone = []
    for run in fs.listStatus(at) if fs.exists(at) else []:
        name = run.getPath().getName()
        below = [name] if name.startswith("merged-") else [f"{name}/{x.getPath().getName()}" for x in fs.listStatus(run.getPath()) if x.isDirectory()]
        gone += [x for x in below if x not in kept]
    for run in gone:
        fs.delete(_path(spark, f"{root}/runs/{run}")[0], True)
    for v in range(1, max(1, now - keep + 1)):
        fs.delete(_path(spark, f"{root}/manifest/v{v}")[0], True)
    fs.delete(_path(spark, f"{root}/staged")[0], True)
    return gone


def _measured(spark: SparkSession, root: str, runs: list[str], schema) -> list[tuple[str, int, int, int]]:
    out = []
    for run in runs:
        rows = spark.read.schema(schema).parquet(f"{root}/runs/{run}")
        at, fs = _path(spark, f"{root}/runs/{run}")
        sizes = [s.getLen() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")]
        out.append((run, rows.count(), sum(sizes), len(sizes)))
    return out


def append(docs: DataFrame, root: str, arrival: Column) -> int:
    """Append ``docs`` as one run for each value of ``arrival`` (few small integers); returns the version.

    Every task writes its own small shards, so nothing is shuffled. An empty table commits an empty list.
    """
    spark = docs.sparkSession
    base, stem = version(spark, root), uuid.uuid4().hex[:12]
    folder = f"{root}/runs/{stem}"
    name = free_name(docs, "weft_arrival")
    docs.withColumn(name, arrival).write.partitionBy(name).parquet(folder)
    at, fs = _path(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
    fresh = _measured(spark, root, [f"{stem}/{n}" for n in names], docs.schema)
    held = [tuple(r) for r in manifest(spark, root).collect()]
    return commit(spark, root, held + [r for r in fresh if r[1]], base)


def tier_of(size: int, fanout: int = FANOUT) -> int:
    return math.floor(math.log(max(size, 1), fanout))


def plan(runs: list[tuple[str, int]], fanout: int = FANOUT) -> list[list[str]]:
    """Groups of runs to merge: as long as a tier has ``fanout`` runs, they become one run of their total size."""
    groups = [([name], size) for name, size in runs]
    while True:
        tiers: dict[int, list] = {}
        for g in sorted(groups, key=lambda g: (g[1], g[0])):
            tiers.setdefault(tier_of(g[1], fanout), []).append(g)
        full = next((t for t in sorted(tiers) if len(tiers[t]) >= fanout), None)
        if full is None:
            return sorted(sorted(names) for names, _ in groups)
        merged = tiers.pop(full)
        groups = [g for rest in tiers.values() for g in rest] + [(sum((g[0] for g in merged), []), sum(g[1] for g in merged))]


def compact(spark: SparkSession, root: str, schema, fanout: int = FANOUT, target_bytes: int = TARGET_BYTES) -> int:
    """Merge by ``plan`` into files of about ``target_bytes`` and commit; returns the version.

    A run alone in its group is rewritten only if it has more than twice the files it needs. The
    planning works on the manifest, one entry a run; the rows move by a narrow coalesce, without a shuffle.
    """
    base = version(spark, root)
    held = {r.run: r for r in manifest(spark, root).collect()}
    runs: list[tuple[str, int, int, int]] = []
    for group in plan([(r.run, r.bytes) for r in held.values()], fanout):
        size, files = sum(held[g].bytes for g in group), sum(held[g].files for g in group)
        need = max(1, -(-size // target_bytes))
        if len(group) == 1 and files <= 2 * need:
            runs.append(tuple(held[group[0]]))
            continue
        name = f"merged-{uuid.uuid4().hex[:12]}"
        spark.read.schema(schema).parquet(*[f"{root}/runs/{g}" for g in group]).coalesce(need).write.parquet(f"{root}/runs/{name}")
        runs += _measured(spark, root, [name], schema)
    return commit(spark, root, runs, base)


def read(spark: SparkSession, root: str, schema) -> DataFrame:
    """All rows of the committed version."""
    runs = [r.run for r in manifest(spark, root).collect()]
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/runs/{r}" for r in runs])


def arrival_of(column: str) -> Column:
    """Eighteen arrivals of uneven size: a half, a quarter, and sixteen of a sixty-fourth."""
    slot = F.pmod(F.xxhash64(column), F.lit(64)).cast("int")
    return F.when(slot < 32, 0).when(slot < 48, 1).otherwise(slot - 46)


def shard_documents(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Shard ``docs`` in the shared folder and read them back through the manifest.

    One row per row of ``docs``: doc_id, text_sha256 (null text: empty), manifest_version. All
    columns are stored as they are, nulls and repeated rows too; an empty table gives no row.
    """
    spark, root = docs.sparkSession, new_path(docs.sparkSession, "shards")
    append(docs, root, arrival_of("doc_id"))
    now = compact(spark, root, docs.schema, target_bytes=target_bytes)
    vacuum(spark, root)
    stored = read(spark, root, docs.schema)
    return stored.select("doc_id", F.sha2(text_of().cast("binary"), 256).alias("text_sha256"), F.lit(now).cast("long").alias("manifest_version"))


ORACLE = "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, CAST(2 AS BIGINT) AS manifest_version FROM documents"
