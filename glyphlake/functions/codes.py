"""Lengths of integer and symbol codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INFINITE = 0x7FFFFFFF
#: First and last integer of each range, prefix, bits of the prefix, further bits.
INTEGER_RANGES = (
    (-INFINITE, -4436, 0x3F, 6, 32),
    (-4435, -340, 0x3E, 6, 12),
    (-339, -84, 0x1E, 5, 8),
    (-83, -20, 0x0E, 4, 6),
    (-19, -4, 0x06, 3, 4),
    (-3, -2, 0x05, 3, 1),
    (-1, -1, 0x09, 4, 0),
    (0, 3, 0x00, 2, 2),
    (4, 19, 0x02, 3, 4),
    (20, 83, 0x06, 4, 6),
    (84, 339, 0x0E, 5, 8),
    (340, 4435, 0x1E, 6, 12),
    (4436, INFINITE, 0x1F, 6, 32),
)
#: The code that ends a list, and its bits.
OUT_OF_BAND, OUT_OF_BAND_BITS = 0x08, 4


def range_table(spark: SparkSession) -> DataFrame:
    """The ranges as a table of thirteen rows."""
    return spark.createDataFrame([(a, b, n, m) for a, b, _, n, m in INTEGER_RANGES], "first int, last int, prefix_bits int, more_bits int")


def with_code_bits(rows: DataFrame, value: str, name: str = "bits") -> DataFrame:
    """``rows`` with the bits that each value takes; null is out of band. A range join with the thirteen rows, which are broadcast."""
    table = F.broadcast(range_table(rows.sparkSession))
    joined = rows.join(table, F.col(value).between(F.col("first"), F.col("last")), "left")
    bits = F.coalesce(F.col("prefix_bits") + F.col("more_bits"), F.lit(OUT_OF_BAND_BITS))
    return joined.select(*(F.col(c) for c in rows.columns), bits.alias(name))


def code_of(value: int | None) -> tuple[int, int]:
    """Code word and length of an integer; None is out of band."""
    if value is None:
        return OUT_OF_BAND, OUT_OF_BAND_BITS
    for first, last, prefix, prefix_bits, more in INTEGER_RANGES:
        if first <= value <= last:
            # the ranges below zero count away from it
            offset = last - value if value < 0 else value - first
            return (prefix << more) | offset, prefix_bits + more
    raise ValueError(f"{value} is out of range")


def id_bits(count: Column) -> Column:
    """Bits of an id among ``count`` symbols: the least n with 2**n >= count, by integers alone."""
    n = F.greatest(count.cast("long"), F.lit(1)) - 1
    return F.when(n <= 0, 0).otherwise(F.length(F.bin(n)))
