"""Approximate nearest neighbours by learned partitions.

Fitting, on at most ``SAMPLE_ROWS`` vectors: their neighbour graph is partitioned into parts of
equal size with few edges between them (halving along principal directions, then moves
that gain edges while parts stay balanced), and a softmax classifier learns in which parts a
vector's neighbours lie. Every row is then indexed under its most probable part. A query
goes to as many of its most probable parts as the sample needed to reach ``RECALL`` and is
compared exactly with all rows there; the best are ranked by inner product.

Parts are cut into blocks of rows and of queries, so that a task's share is bounded however
large a part is; a block pair is one matrix product and returns at most k rows a query. With
a single part the search is exact.

Vectors that are null, empty, zero, of another dimension than the sample's, or that hold null
or non-finite components take no part, nor do rows without vec_id. Of rows that repeat a vec_id
one takes part. Ties go to the smaller vec_id. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

#: Most vectors that the partition is learned from.
SAMPLE_ROWS = 8192
#: Rows that a part is meant to hold, and the most parts there are.
PART_ROWS, MOST_PARTS = 5000, 256
#: Recall within the sample that sets the number of parts a query goes to.
RECALL = 0.95
GRAPH_K = 12
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4096
#: Room for rounding when candidates are preselected by a matrix product.
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, vec binary: doubles) of the vectors that take part, one for each vec_id."""
    v = F.col("embedding")
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vec": [np.asarray(x, "<f8").tobytes() for x in batch["embedding"]]})

    return rows.mapInPandas(pack, "vec_id long, vec binary").groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(vecs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)


def neighbours_of(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row, itself left out."""
    out = np.empty((len(x), k), np.int64)
    y = x.astype(np.float32)
    for a in range(0, len(x), 1024):
        s = y[a : a + 1024] @ y.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 0.1, passes: int = 12) -> np.ndarray:
    """A part for each row: equal sizes, few neighbour edges cut. ``parts`` is a power of two."""
    part = np.zeros(len(x), np.int64)
    p = 1
    while p < parts:  # halve each part along its principal direction
        new = part * 2
        for q in range(p):
            rows = np.flatnonzero(part == q)
            if len(rows) > 1:
                c = x[rows] - x[rows].mean(axis=0)
                axis = np.linalg.eigh(c.T @ c)[1][:, -1]
                new[rows[np.argsort(c @ axis, kind="stable")[len(rows) // 2 :]]] += 1
        part, p = new, p * 2
    room = int(np.ceil(len(x) / parts * (1 + slack)))
    least = int(len(x) / parts * (1 - slack))
    source = np.repeat(np.arange(len(x)), near.shape[1])
    ends = np.concatenate([source, near.ravel()]), np.concatenate([near.ravel(), source])
    for _ in range(passes):
        count = np.zeros((len(x), parts), np.int32)
        np.add.at(count, (ends[0], part[ends[1]]), 1)
        best = count.argmax(axis=1)
        gain = count[np.arange(len(x)), best] - count[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room and size[part[i]] > least:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A softmax classifier of vectors into parts."""

    weights: np.ndarray  # dimension + 1 by parts
    probes: int

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    @property
    def dimension(self) -> int:
        return len(self.weights) - 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return x @ self.weights[:-1] + self.weights[-1]


def softmax_fit(x: np.ndarray, target: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> np.ndarray:
    """Weights by Adam over the whole sample."""
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((len(x), 1))]).astype(np.float32)
    target = target.astype(np.float32)
    w = np.zeros((x.shape[1], target.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - target) / len(x) + decay * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float64)


def fit(vectors: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS) -> Router | None:
    """A router learned from ``vectors`` (vec_id, vec); None if there are no vectors."""
    total = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()  # bounded
    if not len(sample):
        return None
    sizes = sample["vec"].map(len)
    sample = sample[sizes == sizes.mode().max()]
    x = matrix(sample["vec"])
    wanted = total / PART_ROWS
    parts = 1
    while parts * 2 <= min(wanted * 1.42, MOST_PARTS, len(x) / 32):
        parts *= 2
    if parts == 1:
        return Router(np.zeros((x.shape[1] + 1, 1)), 1)
    test = np.arange(len(x)) % 4 == 0  # is left out of the classifier's fitting
    near = neighbours_of(x, max(GRAPH_K, min(k, len(x) - 1)))
    part = balanced_parts(x, near[:, :GRAPH_K], parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    target[np.arange(len(x)), part] += 1
    target /= target.sum(axis=1, keepdims=True)
    router = Router(softmax_fit(x[~test], target[~test]), 1)
    logits = router.logits(x)
    own = logits.argmax(axis=1)  # where the index puts each row
    order = np.argsort(-logits[test], axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(rank, own[near[test][:, :k]], axis=1)  # probes that find each neighbour
    found = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    router.probes = int(np.searchsorted(found, RECALL)) + 1
    return router


def search(vectors: DataFrame, queries: DataFrame, k: int, router: Router) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` found for each of ``queries`` (both vec_id, vec)."""
    weights = queries.sparkSession.sparkContext.broadcast(router)  # dimension x parts: bounded
    width = 8 * router.dimension

    def routed(most: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = weights.value
            for batch in batches:
                batch = batch[batch["vec"].map(len) == width]
                if len(batch):
                    logits = r.logits(matrix(batch["vec"]))
                    parts = np.argsort(-logits, axis=1, kind="stable")[:, :most]
                    yield batch.loc[batch.index.repeat(parts.shape[1])].assign(part=parts.ravel().astype(np.int32))

        return run

    schema = "vec_id long, vec binary, part int"
    index = store.stage(vectors.mapInPandas(routed(1), schema), "index")
    asked = store.stage(queries.mapInPandas(routed(min(router.probes, router.parts)), schema), "routed-queries")
    size = dict.fromkeys(range(router.parts), 0) | {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # a row for each part
    load = dict.fromkeys(range(router.parts), 0) | {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    blocks = F.array(*(F.lit(max(1, -(-size[p] // BLOCK_ROWS))) for p in range(router.parts)))
    shares = F.array(*(F.lit(max(1, -(-load[p] // BLOCK_QUERIES))) for p in range(router.parts)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), n[F.col("part")]).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n[F.col("part")] - 1))
    left = asked.withColumn("share", dealt(shares)).withColumn("block", every(blocks))
    right = index.withColumn("block", dealt(blocks)).withColumn("share", every(shares))

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(c):
            c = c.sort_values("vec_id")
            ids, a, b = c["vec_id"].to_numpy(), matrix(q["vec"]), matrix(c["vec"])
            for at in range(0, len(q), 256):
                scores = a[at : at + 256] @ b.T
                for i, row in enumerate(scores, at):
                    own = int(q["vec_id"].iloc[i])
                    row[ids == own] = -np.inf
                    least = np.partition(row, max(0, len(row) - k))[max(0, len(row) - k)]
                    near = np.flatnonzero((row >= least - SLACK * max(1.0, abs(least))) & (ids != own))
                    exact = np.zeros(len(near))
                    for d in range(a.shape[1]):  # one order of summation for every pair, so that copies tie
                        exact += a[i, d] * b[near, d]
                    best = np.lexsort((ids[near], -exact))[:k]
                    out += zip([own] * len(best), ids[near][best].tolist(), exact[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ("part", "block", "share")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """The k nearest of all rows of ``vectors`` (vec_id, embedding) for those whose vec_id ``every`` divides."""
    rows = store.stage(usable(vectors), "vectors")
    router = fit(rows, k)
    if router is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(rows, rows.where(F.col("vec_id") % every == 0), k, router)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(store.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=20, k=20)


#: Brute force: equals the search where the table is small enough for a single part.
OP5_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
