"""Strips of placed symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import bits


def strips(rows: DataFrame, y: Column, height: int) -> DataFrame:
    """``rows`` with strip_top: the multiple of ``height`` at or above ``y``."""
    return rows.withColumn("strip_top", (F.floor(y / height) * height).cast("long"))


def positions(rows: DataFrame, by: list[str], x: str, key: str) -> DataFrame:
    """``rows`` with pos, their place in the strip by ``x``, then ``key``, from 0."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(x, key)) - 1)


def gaps(rows: DataFrame, by: list[str], x: str, width: Column, key: str) -> DataFrame:
    """``rows`` with gap: from the last pixel of the one before in the strip to ``x``; null for the first."""
    inside = Window.partitionBy(*by).orderBy(x, key)
    end = F.col(x) + width - 1
    return rows.withColumn("gap", F.col(x) - F.lag(end).over(inside))


def common_gap(rows: DataFrame, gap: str = "gap", least: int = -16, most: int = 15) -> DataFrame:
    """The most frequent gap of 0 or more, the smallest of equally frequent ones, held to [least, most]; 0 if there is none."""
    counts = rows.where(F.col(gap) >= 0).groupBy(gap).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max(F.struct(F.col("n"), -F.col(gap))).alias("b"))
    return best.select(F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(-F.col("b.col2"), F.lit(0)))).cast("long").alias("common_gap"), F.coalesce(F.col("b.n"), F.lit(0)).cast("long").alias("n"))


def deltas(rows: DataFrame, by: list[str], y: str, x: str, height: int) -> DataFrame:
    """One row for each strip of ``rows`` (by, strip_top, y, x): its steps from the strip before, in strips and in ``x`` of the first symbol."""
    first = rows.groupBy(*by, "strip_top").agg(F.min(x).alias("first_x"), F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*by).orderBy("strip_top")
    zero = F.lit(0)
    return first.select(
        *by,
        "strip_top",
        "n",
        ((F.col("strip_top") - F.coalesce(F.lag("strip_top").over(inside), zero)) / height).cast("long").alias("delta_top"),
        (F.col("first_x") - F.coalesce(F.lag("first_x").over(inside), zero)).cast("long").alias("delta_x"),
    )


def resolve(near: DataFrame, lossy: bool = False) -> DataFrame:
    """What becomes of each mark, by its best dictionary entry (ref_id, mm): a plain reference, one with a refinement, or the cleanup page."""
    matched = F.col("ref_id").isNotNull()
    plain = matched if lossy else matched & (F.col("mm") == 0)
    return near.withColumn("placed", F.when(plain, "reference").when(matched, "refined").otherwise("cleanup"))


def substitute(marks: DataFrame, references: DataFrame) -> DataFrame:
    """Marks that refer to another take its bitmap; they move so that the alignment points fall together."""
    ref = references.select(F.col("mark_id").alias("ref_id"), *(F.col(c).alias(f"r_{c}") for c in ("width", "height", "c_x", "c_y", "bitmap")))
    out = marks.join(ref, "ref_id", "left")
    pick = lambda new, old: F.when(F.col("r_bitmap").isNotNull(), new).otherwise(old)
    x, y = F.col("ul_x") + F.col("c_x") - F.col("r_c_x"), F.col("ul_y") + F.col("c_y") - F.col("r_c_y")
    moved = {"ul_x": pick(x, F.col("ul_x")), "ul_y": pick(y, F.col("ul_y"))} | {c: pick(F.col(f"r_{c}"), F.col(c)) for c in ("width", "height", "c_x", "c_y", "bitmap")}
    out = out.withColumns(moved).drop("r_width", "r_height", "r_c_x", "r_c_y", "r_bitmap")
    return out.withColumns({"ref_x": F.col("ul_x"), "ref_y": F.col("ul_y") + F.col("height") - 1})


def flipped(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, flipped, share) of two tables of rasters (keys, words: packed bits, area): pixels that differ, and their share."""
    both = before.join(after.select(*keys, F.col("words").alias("after")), keys)
    return both.select(*keys, bits.differing(F.col("words"), F.col("after")).alias("flipped"), (bits.differing(F.col("words"), F.col("after")) / F.col("area")).alias("share"))
