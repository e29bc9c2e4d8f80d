"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with zeros, become the 8-bit grey samples of a lossless PNG
image 64 wide. Images go into tar shards under the digest of their payload; a task writes
each digest once, and where several tasks have it, one entry serves all rows. Rows carry digest, shard, offset and length. Metadata columns come from
range reads of the image headers alone; features come from reading the stored samples back.
"""

from __future__ import annotations

import math
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialise, new_path, small_batches

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, IHDR and the private chunk with the unpadded length.
HEADER = 8 + 25 + 20
LEVEL = 3
SHARD_BYTES = 256 << 20
#: Images that one task reads back.
READ_BYTES = 64 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes padded with zeros to a positive multiple of 64, and the unpadded length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"nbYt", struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> dict[str, int]:
    """Width, height, bit depth and unpadded length from the first ``HEADER`` bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or head[37:41] != b"nbYt":
        raise ValueError("not an image of this store")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return {"width": width, "height": height, "bit_depth": depth, "n_bytes": struct.unpack(">Q", head[41:49])[0]}


def from_png(image: bytes) -> tuple[bytes, int]:
    head = read_header(image[:HEADER])
    (size,) = struct.unpack(">I", image[HEADER : HEADER + 4])
    raw = np.frombuffer(zlib.decompress(image[HEADER + 8 : HEADER + 8 + size]), np.uint8).reshape(head["height"], head["width"] + 1)
    if raw[:, 0].any():
        raise ValueError("only unfiltered rows are stored")
    return np.ascontiguousarray(raw[:, 1:]).tobytes(), head["n_bytes"]


def feature_of(samples: bytes) -> str:
    """Height, mean, deviation and entropy of the samples, and the mean of each eighth of the rows' width."""
    grid = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    counts = np.bincount(grid.ravel(), minlength=256)
    p = counts[counts > 0] / grid.size
    values = np.arange(256)
    mean = int((counts * values).sum()) / grid.size
    spread = math.sqrt(max(0.0, int((counts * values * values).sum()) / grid.size - mean * mean))
    bands = grid.sum(axis=0, dtype=np.int64).reshape(8, 8).sum(axis=1) / (len(grid) * 8)
    return f"h={len(grid)};mean={mean:.4f};sd={spread:.4f};entropy={-(p * np.log2(p)).sum():.4f};bands=" + "/".join(f"{b:.2f}" for b in bands)


class _Shard:
    """A tar file under a name of its own, so that a repeated attempt never meets another's file."""

    def __init__(self, folder: str) -> None:
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tar"
        self.out = self.fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.at, self.seen = 0, {}

    def add(self, name: str, data: bytes) -> tuple[int, int]:
        if name not in self.seen:
            info = tarfile.TarInfo(f"{name}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
            self.out.write(head)
            self.out.write(data)
            self.out.write(b"\0" * (-len(data) % 512))
            self.seen[name] = self.at + len(head), len(data)
            self.at += len(head) + len(data) + -len(data) % 512
        return self.seen[name]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def _stored(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            if shard is not None and shard.at >= SHARD_BYTES:
                shard.close()
                shard = None
            shard = shard or _Shard(folder)
            digests, spots = [], []
            for text in batch.column(1):
                payload, n_bytes = payload_of(text.as_py())
                # the length belongs to the address: padding must not make two texts one
                name = sha256(struct.pack(">Q", n_bytes) + payload).hexdigest()
                spot = shard.seen.get(name) or shard.add(name, to_png(payload, n_bytes))
                digests.append(name)
                spots.append(spot)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "digest": pa.array(digests, pa.string()),
                    "shard": pa.array([shard.name] * len(digests), pa.string()),
                    "offset": pa.array([s[0] for s in spots], pa.int64()),
                    "length": pa.array([s[1] for s in spots], pa.int64()),
                }
            )
        if shard is not None:
            shard.close()

    return run


class _Reader:
    def __init__(self, folder: str) -> None:
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.base}/{shard}")
        return self.file.read_at(length, offset)


def _headers(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for batch in batches:
            heads = [read_header(reader.read(s, o, HEADER)) for s, o in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), strict=True)]
            more = {k: pa.array([h[k] for h in heads], pa.int64()) for k in ("width", "height", "bit_depth", "n_bytes")}
            yield pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns, strict=True)) | more)

    return run


def _features(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for batch in batches:
            out, memo = [], {}
            for s, o, n in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
                if (s, o) not in memo:
                    image = reader.read(s, o, n)
                    samples, _ = from_png(image)
                    memo[s, o] = (len(samples), sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), sha256(image).hexdigest(), feature_of(samples))
                out.append(memo[s, o])
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature")
            more = {k: pa.array([r[i] for r in out]) if out else pa.array([], pa.string()) for i, k in enumerate(names)}
            yield pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns, strict=True)) | more)

    return run


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the payloads of ``docs`` under ``folder``; returns rows and entries.

    Rows: doc_id, digest, one per row of ``docs``. Entries, one per digest: digest, copies, shard, offset, length,
    width, height, bit_depth, n_bytes; in partitions of about ``READ_BYTES`` of images, in the order of the shards.
    Null counts as empty (one row of zeros). Equal texts have equal digests and one entry. A lost task writes a new
    shard; only shards that the committed index names count. An empty table gives empty results.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, digest string, shard string, offset long, length long"
    index = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_stored(f"{folder}/shards"), schema)
    index.write.parquet(f"{folder}/index")
    found = spark.read.schema(schema).parquet(f"{folder}/index")
    entries = found.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("shard", "offset", "length")).alias("at"))
    entries = materialise(entries.select("digest", "copies", "at.*"), "entries")
    size = entries.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    entries = entries.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    held = "digest string, copies long, shard string, offset long, length long"
    return found.select("doc_id", "digest"), entries.mapInArrow(_headers(f"{folder}/shards"), held + ", width long, height long, bit_depth long, n_bytes long")


def features(entries: DataFrame, folder: str) -> DataFrame:
    """``entries`` with payload_bytes, payload_sha256, tail_crc32, media_sha256 and feature, read from the shards."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInArrow(_features(f"{folder}/shards"), schema + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store ``docs`` in the shared folder, read every entry back, and return the contract's columns."""
    folder = new_path(docs.sparkSession, "media")
    rows, entries = store(docs, folder)
    # digests move as 32 bytes, not as their 64 letters
    digests = ("digest", "payload_sha256", "media_sha256")
    columns = ("copies", "length", "n_bytes", "payload_bytes", "tail_crc32", "feature")
    told = materialise(features(entries, folder).select(*columns, *(F.unhex(c).alias(c) for c in digests)), "features")
    out = join_groups(rows.select("doc_id", F.unhex("digest").alias("digest")), told, "digest", "copies", rows.count())
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_bytes", "payload_bytes", text("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), text("media_sha256"), "feature")
