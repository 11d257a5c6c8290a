"""Bit filters as tables: built, and tested, by DataFrame functions alone.

A filter is a table (bucket, bitmap) of ``bits`` bits, ``MAX_BITS`` (32 MB) at
most, which is the proven bound of what is broadcast. A filter only spares rows
a shuffle; a bit that is set by chance lets a row through that a later exact
join drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stage, free_name

MAX_BITS = 1 << 28


def size_for(n: int, max_bits: int = MAX_BITS) -> int:
    """16 bits for each of n keys, a power of two, within bounds."""
    return min(max_bits, 1 << max(20, (16 * max(1, n) - 1).bit_length()))


def bits_of(rows: DataFrame, key: Column, bits: int, stage: Stage, repeated: bool = False) -> DataFrame:
    """The bits that keys set; with repeated, those that at least two rows set."""
    pos = rows.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("pos"))
    if repeated:
        pos = pos.groupBy("pos").count().where("count > 1")
    else:
        pos = pos.distinct()
    made = pos.groupBy(F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bitmap"))
    return stage.keep(made)


def test(rows: DataFrame, key: Column, filter_: DataFrame, bits: int, name: str) -> DataFrame:
    """rows with the boolean column ``name``: is the key's bit set?"""
    pos, bucket, bitmap = (free_name([*rows.columns, name], f"_tess_{x}") for x in ("pos", "bucket", "bitmap"))
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, cast(bitmap_bit_position({pos}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.bitmap_bit_position(pos) % 8).cast("int")) % 2 == 1
    return (
        rows.withColumn(pos, F.pmod(F.xxhash64(key), F.lit(bits)))
        .withColumn(bucket, F.bitmap_bucket_number(pos))
        .join(F.broadcast(filter_.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))), bucket, "left")
        .withColumn(name, F.coalesce(bit, F.lit(False)))
        .drop(pos, bucket, bitmap)
    )


def among(rows: DataFrame, ids: DataFrame, key: str, stage: Stage) -> DataFrame:
    """rows whose key may be among ids (a column of the same name): all that are, and a few by chance. Nothing of rows shuffles."""
    bits = size_for(ids.count())
    maybe = free_name(rows.columns, "_tess_maybe")
    return test(rows, F.col(key), bits_of(ids, F.col(key), bits, stage), bits, maybe).where(maybe).drop(maybe)


def without(rows: DataFrame, ids: DataFrame, key: str, stage: Stage) -> DataFrame:
    """rows whose key is not among ids (one column of the same name). Only rows that may be shuffle; null keys stay."""
    bits = size_for(ids.count())
    maybe = free_name(rows.columns, "_tess_maybe")
    marked = test(rows, F.col(key), bits_of(ids, F.col(key), bits, stage), bits, maybe)
    sure = marked.where(~F.col(maybe)).drop(maybe)
    return sure.unionByName(marked.where(maybe).drop(maybe).join(ids.select(key), key, "left_anti").select(*rows.columns))
