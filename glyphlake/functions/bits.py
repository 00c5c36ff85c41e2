"""Bitmaps as Column expressions: packed words, counts, centres, scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def pack(bits: Column) -> Column:
    """An array of 0 and 1 as array<long>, 64 a word, the first bit highest."""
    words = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(bits) / WORD).cast("int") - 1))
    join = lambda w: F.aggregate(F.slice(bits, w * WORD + 1, F.lit(WORD)), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))
    return F.transform(words, join)


def total(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def combine(a: Column, b: Column, f) -> Column:
    """Black pixels of ``f`` over the words of two bitmaps of one size."""
    return F.aggregate(F.zip_with(a, b, f), F.lit(0), lambda n, w: n + F.bit_count(w))


def differing(a: Column, b: Column) -> Column:
    return combine(a, b, lambda x, y: x.bitwiseXOR(y))


def xor_score(a: Column, b: Column, area: Column) -> Column:
    """Share of pixels that differ."""
    return differing(a, b) / area


def binary_entropy(p: Column) -> Column:
    """In nats; 0 at both ends, null where p is."""
    return F.when((p == 0) | (p == 1), F.lit(0.0)).when(p.isNotNull(), -(p * F.ln(p) + (1 - p) * F.ln(1 - p)))


#: Up to so many pixels, logarithms are read from a table.
TABLE = 4096


def conditional_entropy(lost: Column, gained: Column, black: Column, area: Column, most: int | None = None) -> Column:
    """Entropy, a pixel, of a bitmap given a reference of ``black`` pixels of which it lost some and beside which it gained some.

    With ``most``, the largest area, of up to ``TABLE`` pixels, n * H(k / n) is t(n) - t(k) - t(n - k) where t(n) = n * ln(n).
    """
    white = area - black
    if most is None or most > TABLE:
        some = lambda n, of: F.when(of > 0, n / of)
        return (binary_entropy(some(lost, black)) * black + binary_entropy(some(gained, white)) * white) / area
    table = F.lit(np.array([n * math.log(n) if n else 0.0 for n in range(most + 1)]))
    at = lambda n: F.get(table, n)
    part = lambda n, of: at(of) - at(n) - at(of - n)
    return F.when((black > 0) & (white > 0), (part(lost, black) + part(gained, white)) / area)


def entropy_score(a: Column, ref: Column, area: Column) -> Column:
    """Conditional entropy of a bitmap given a reference, a pixel. Null, which matches nothing, if the reference is all black or all white."""
    lost = combine(a, ref, lambda x, y: y.bitwiseAND(F.bitwise_not(x)))
    gained = combine(a, ref, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))
    return conditional_entropy(lost, gained, total(ref), area)


def rounded(x: Column, places: int) -> Column:
    """``F.round`` of values under 1,000 in size to 6 places or fewer; decimals, which are slow, decide only within a millionth of a tie."""
    scaled = x * 10.0**places
    down = F.floor(scaled)
    return F.when(F.abs(scaled - down - 0.5) > 1e-6, (down + F.when(scaled - down > 0.5, 1).otherwise(0)) / 10.0**places).otherwise(F.round(x, places))


def center(width: Column, height: Column) -> tuple[Column, Column]:
    """The middle pixel; of an even width the left one, of an even height the lower one."""
    return F.floor((width - 1) / 2).cast("int"), F.floor(height / 2).cast("int")
