"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one
row for each digest, the digests that the index holds already are removed by a
sort-merge anti-join, and what is left is appended. The index side of that join is never
shuffled. Each appended batch adds a sorted file to every bucket, which the join sorts
together bucket by bucket; ``compact`` makes them one file again. Only digests travel;
texts are never shuffled to decide which row stays.

The number of buckets is part of the index: it is stored beside the digests, used whenever
the index is opened again, and another one is refused.

Nulls: a null text is the empty text, and a null doc_id sorts after all others. Texts
that are identical after white space is collapsed are equal, however long. Repeated rows
(same doc_id and text) are members of one group. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

SPACE = r"[\x20\x09-\x0D]+"
#: Rows of the index that one bucket is meant to hold.
ROWS_A_BUCKET = 2_000_000


def normalised(text: str = "text"):
    return F.regexp_replace(store.text_or_empty(text), SPACE, " ")


def digest(text: str = "text"):
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digests seen so far: (digest binary, keep_id long), bucketed and sorted by digest.

    ``buckets`` counts for a new index only; the default is one for each ``ROWS_A_BUCKET`` of
    ``expected`` rows and at least Spark's own number of partitions. An index that exists is opened with the number it was
    written with. ``close`` (or leaving the with block) takes the table out of the catalogue; the files stay.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None, expected: int = 0):
        self.spark = spark
        self.location = location or store.new_path(spark, "digest-index")
        stored = self._stored_buckets()
        if stored is None:
            self.buckets = buckets or max(store.parallelism(spark), -(-expected // ROWS_A_BUCKET))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.json(self._layout())
        elif buckets not in (None, stored):
            raise ValueError(f"the index at {self.location} has {stored} buckets, not {buckets}")
        else:
            self.buckets = stored
        self._register()

    def _register(self) -> None:
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._data()}'"
        )

    def _layout(self) -> str:
        return f"{self.location}/layout"

    def _data(self) -> str:
        return f"{self.location}/digests"

    def _stored_buckets(self) -> int | None:
        if store.exists(self.spark, self._layout()):
            row = self.spark.read.schema("buckets int").json(self._layout()).first()
            if row is not None:
                return row["buckets"]
        elif not store.exists(self.spark, self._data()):
            return None
        raise ValueError(f"the index at {self.location} doesn't say how many buckets it has")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, groups: DataFrame) -> DataFrame:
        """Those rows of ``groups`` (digest, keep_id; one row a digest) that the index lacks."""
        return groups.select("digest", F.col("keep_id").cast("long").alias("keep_id")).hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame) -> None:
        """Append those rows of ``groups`` that the index lacks."""
        self._write(self.fresh(groups), self.name)
        self.spark.catalog.refreshTable(self.name)

    def _write(self, rows: DataFrame, name: str) -> None:
        # hash partitioning is the bucketing function, so each bucket gets one sorted file
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(name)

    def compact(self, location: str | None = None) -> DigestIndex:
        """The same index in a new place, with one file for each bucket; this one stays as it is."""
        out = DigestIndex(self.spark, location, self.buckets)
        # read as plain files: Spark would take a lone bucketed scan as dealt out already, and then not scan it by buckets
        out._write(self.spark.read.schema("digest binary, keep_id long").parquet(self._data()), out.name)
        self.spark.catalog.refreshTable(out.name)
        return out


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, copies, kept, digest) for each row of ``docs`` (doc_id, text).

    keep_id is the doc_id that stays: the smallest of the batch, or the one in ``index`` if an
    earlier batch brought the text. group_size counts the batch's rows with that text and
    copies those of them that also carry keep_id. The new digests join the index.
    """
    spark = docs.sparkSession
    rows = store.stage(docs.select(F.col("doc_id"), digest().alias("digest")), "digests")
    if index is None:
        with DigestIndex(spark, expected=rows.count()) as own:
            return _decided(rows, own)
    return _decided(rows, index)


def _decided(rows: DataFrame, index: DigestIndex) -> DataFrame:
    # the pair (digest, doc_id) spreads the copies of one text over all tasks before they meet as counts
    pairs = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        # null ids last, but counted where there are no others
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n"))["n"].alias("copies"),
    )
    groups = store.stage(groups, "digest-groups")
    index.add(groups)
    total = rows.count()
    facts = groups.select("digest", "group_size", "copies").hint("merge").join(index.rows().hint("merge"), "digest")
    facts = store.stage(facts, "digest-facts")
    out = store.attach(rows, facts, "digest", "group_size", total)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce("copies", F.lit(1)).alias("copies"), same.alias("kept"), "digest")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, one for each text."""
    decided = deduplicate(docs.select("doc_id", "text")).where("kept").groupBy("doc_id", "digest").agg(F.max("copies").alias("copies"))
    marked = docs.withColumn("__digest", digest())
    pick = decided.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__d"), F.col("copies").alias("__copies"))
    # the ids are small, so they are hashed and the texts stream past unsorted
    joined = marked.join(pick.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__d")))
    once = joined.where("__copies = 1").select(*docs.columns)
    again = joined.where("__copies > 1").dropDuplicates(["__id", "__d"]).select(*docs.columns)
    return once.unionByName(again)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(store.table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""
