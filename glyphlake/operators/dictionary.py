"""Building, ordering and updating a dictionary of symbols."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matching
from .staging import cut


def sequential_dictionary(marks: DataFrame, by: list[str], threshold: float, keep_flags: bool = True) -> DataFrame:
    """Every mark in order with its best earlier one: (mark_id, ref_id, mm, singleton, perfect).

    All marks enter, so the fold over them is a self-join. A singleton is referred to by no other; with
    ``keep_flags`` off none counts as one.
    """
    near = cut(matching.nearest_earlier(marks, by, threshold))
    used = near.where("ref_id IS NOT NULL").select(F.col("ref_id").alias("mark_id")).distinct().withColumn("used", F.lit(True))
    alone = F.col("used").isNull() if keep_flags else F.lit(False)
    return near.join(used, "mark_id", "left").select("mark_id", "ref_id", "mm", alone.alias("singleton"), F.coalesce(F.col("mm") == 0, F.lit(False)).alias("perfect"))


def unreferenced(entries: DataFrame) -> DataFrame:
    """Entries that no other refers to."""
    return entries.join(entries.select(F.col("ref_id").alias("mark_id")), "mark_id", "left_anti")


def without_singletons(entries: DataFrame) -> DataFrame:
    """Entries that aren't singletons, numbered anew; references follow."""
    kept = entries.where("NOT singleton")
    numbered = numbered_by(kept, "mark_id")
    return renumbered(numbered)


def numbered_by(entries: DataFrame, *order: str) -> DataFrame:
    """``entries`` with index: their place by ``order``, from 0.

    Rows are ranked inside ranges of the order and the ranges' sizes are summed up, so that no task sees all rows.
    """
    spark = entries.sparkSession
    ranged = cut(entries.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").count()
    before = sizes.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__within", within).join(F.broadcast(before), "__range").withColumn("index", (F.col("__before") + F.col("__within") - 1).cast("long")).drop("__range", "__before", "__within")


def renumbered(entries: DataFrame) -> DataFrame:
    """``entries`` (mark_id, ref_id, index) with ref_index, the index of what they refer to."""
    at = entries.select(F.col("mark_id").alias("ref_id"), F.col("index").alias("ref_index"))
    return entries.join(at, "ref_id", "left")


def point_past_perfect(entries: DataFrame) -> DataFrame:
    """Entries equal to their reference step aside: who refers to one refers to its nearest ancestor that isn't; they become singletons.

    Chains are halved each round.
    """
    state = cut(entries.select("mark_id", "ref_id", "mm", "singleton", "perfect"))
    while True:
        aside = state.where("perfect AND ref_id IS NOT NULL").select(F.col("mark_id").alias("ref_id"), F.col("ref_id").alias("further"))
        moved = cut(state.join(aside, "ref_id", "left").select("mark_id", F.coalesce("further", "ref_id").alias("ref_id"), "mm", "singleton", "perfect", F.col("further").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return state.withColumn("singleton", F.col("singleton") | F.col("perfect"))


def leaders(marks: DataFrame, by: list[str], threshold: float, score: Callable[[bytes, bytes, dict], float] | None = None) -> DataFrame:
    """Only marks that match no leader so far become leaders: (mark_id, leader_id, mm).

    The order within a group decides, so each group of ``by`` is a fold; groups don't touch each other.
    """
    columns = [*by, "mark_id", "words", "area"]

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        heads: list[tuple[int, list[int]]] = []
        out = []
        for mark, words, area in zip(*(group.sort_values("mark_id")[c] for c in ("mark_id", "words", "area"))):
            own = [int(w) & (2**64 - 1) for w in words]
            found = min(((sum((a ^ b).bit_count() for a, b in zip(own, other)) / area, head) for head, other in heads), default=(2.0, -1))
            if found[0] <= threshold:
                out.append((mark, found[1], found[0]))
            else:
                heads.append((mark, own))
                out.append((mark, mark, 0.0))
        return pd.DataFrame(out, columns=["mark_id", "leader_id", "mm"])

    return marks.select(*columns).groupBy(*by).applyInPandas(fold, "mark_id long, leader_id long, mm double")


def kinds(entries: DataFrame, ref: str = "ref_id") -> DataFrame:
    """Entries that stand for themselves are direct, the others are refinements."""
    return entries.withColumn("kind", F.when(F.col(ref).isNull(), "direct").otherwise("refine"))


def height_class_order(entries: DataFrame, height: Column, width: Column, key: str) -> DataFrame:
    """``entries`` with their place among symbols of their height, and steps of height and width.

    Classes ascend by height; in a class widths ascend, equal ones in order of ``key``; the first width of a class counts from 0.
    """
    rows = entries.withColumns({"height": height, "width": width})
    inside = Window.partitionBy("height").orderBy("width", key)
    rows = rows.withColumns({"place": F.row_number().over(inside) - 1, "delta_width": F.col("width") - F.coalesce(F.lag("width").over(inside), F.lit(0))})
    heights = rows.select("height").distinct()  # few: a row for each height
    steps = heights.withColumn("delta_height", F.col("height") - F.coalesce(F.lag("height").over(Window.orderBy("height")), F.lit(0)))
    return rows.join(F.broadcast(steps), "height")


def export_runs(flags: DataFrame, order: str, flag: Column) -> DataFrame:
    """Run lengths of a flag in order: (run, value, length), beginning with a run of false, of length 0 if the first flag is true.

    Islands: a run starts where the flag changes. Starts are numbered in turn, and each meets the next by number, so no task orders them all.
    """
    rows = numbered_by(flags.select(order, flag.alias("value")), order)
    before = rows.select((F.col("index") + 1).alias("index"), F.col("value").alias("last"))
    starts = rows.join(before, "index", "left").where("last IS NULL OR value <> last").select(F.col("index").alias("start"), "value")
    runs = numbered_by(starts, "start")
    n = rows.agg(F.max("index") + 1).first()[0] or 0
    first = rows.where("index = 0").select("value").first()
    shift = int(bool(first and first[0]))
    following = runs.select((F.col("index") - 1).alias("index"), F.col("start").alias("end"))
    out = runs.join(following, "index", "left").select((F.col("index") + shift).alias("run"), "value", (F.coalesce("end", F.lit(n)) - F.col("start")).cast("long").alias("length"))
    empty = flags.sparkSession.createDataFrame([(0, False, 0)] * shift, "run long, value boolean, length long")
    return empty.unionByName(out)


def evict(carried: DataFrame, used: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Carried entries that the page refers to; the others go. With ``by``, columns of ``used`` that name a page, what each page leaves."""
    kept = used.where("ref_id IS NOT NULL").select(*(by or []), F.col("ref_id").alias("mark_id")).distinct()
    return kept.join(carried.drop(*(by or [])), "mark_id") if by else carried.join(kept, "mark_id", "left_semi")
