"""A blocked Bloom filter made of DataFrame functions only.

Bits lie in blocks of 32,768 (one 4 KB bitmap each). The number of blocks is
bounded, so the filter may be broadcast at any input size: beyond the bound more
rows count as possible members, and results that are checked afterwards stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

BLOCK_BITS = 32_768
#: 64 MB of bitmaps at most.
MAX_BLOCKS = 16_384
BITS_PER_KEY = 16


def blocks_for(n_keys: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-n_keys * BITS_PER_KEY // BLOCK_BITS)))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _offset(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BLOCK_BITS)).cast("int")


def build(keys: DataFrame, key: str, n_blocks: int, at_least: int = 1) -> DataFrame:
    """Bitmaps (``__block``, ``__bits``) of the positions that ``at_least`` rows set.

    With ``at_least=2`` a key can only be absent when no other row has it, so the
    filter holds every repeated key.
    """
    k = F.col(key)
    spots = keys.select(
        _block(k, n_blocks).alias("__block"),
        F.explode(F.array_distinct(F.array(_offset(k, 1), _offset(k, 2)))).alias("__offset"),
    )
    if at_least > 1:
        spots = spots.groupBy("__block", "__offset").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= at_least)
    return spots.groupBy("__block").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("__offset") + 1)).alias("__bits")
    )


def _bit(bits: str, offset: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(offset / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (offset % 8).cast("int")))


def probe(rows: DataFrame, key: Column, bitmaps: DataFrame, n_blocks: int, name: str = "__maybe") -> DataFrame:
    """``rows`` with boolean ``name``: false only if the key isn't in the filter. A null key is treated as a value."""
    block, bits = free_name(rows, "__block"), free_name(rows, "__bits")
    maps = bitmaps.select(F.col("__block").alias(block), F.col("__bits").alias(bits))
    found = rows.withColumn(block, _block(key, n_blocks)).join(F.broadcast(maps), block, "left")
    hit = F.col(bits).isNotNull() & (_bit(bits, _offset(key, 1)) != 0) & (_bit(bits, _offset(key, 2)) != 0)
    return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop(block, bits)
