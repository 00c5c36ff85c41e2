"""Shared-folder staging and joins that survive hot keys."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds at least this share of all rows; so at most 1/HOT_SHARE keys are hot, and broadcasting them is bounded.
HOT_SHARE = 1 / 1000

_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one where none is set and all runs on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/glyphlake"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut lineage that outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Remove everything staged so far. Call it once the results that read it have been written."""
    while _STAGED:
        delete(spark, _STAGED.pop())


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(left: DataFrame, facts: DataFrame, key: str | list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``facts`` (one row for each key) when a few keys may hold most rows of ``left``.

    ``weight`` in ``facts`` is the number of rows that the key has in ``left`` and
    ``total`` their sum. Hot keys, fewer than 1/HOT_SHARE of them whatever the size
    of the input, are broadcast and never shuffled; the rest, none of which holds more
    than HOT_SHARE of the rows, is joined by shuffling.
    """
    least = max(1, math.ceil(total * HOT_SHARE))
    if least < 100:  # every key is small
        return left.join(facts, key)
    hot = facts.where(F.col(weight) >= least)
    cold = facts.where(F.col(weight) < least)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
