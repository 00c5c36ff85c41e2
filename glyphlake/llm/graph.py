"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) for each node of ``edges`` (u, v).

    Each round takes the least label among the neighbours (with map-side minima, so that a
    node with very many of them costs a task nothing) and then the label of the label,
    which halves paths. Rounds end when no label changes; each is cut into the shared folder.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = store.stage(both, "edges")
    labels = store.stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        least = labels.join(near, "u").select("u", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        least = store.stage(least, "labels")
        jump = least.select(F.col("u").alias("label"), F.col("label").alias("further"))
        labels = store.stage(least.join(jump, "label").select("u", F.least("label", "further").alias("label"), (F.col("further") != F.col("before")).alias("changed")), "labels")
        if not labels.where("changed").limit(1).count():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = labels.drop("changed")
