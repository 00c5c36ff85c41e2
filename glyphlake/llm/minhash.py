"""Near-duplicate detection by one-permutation MinHash, bands and stars.

1. A document's set holds a 64-bit hash of each of its word shingles. Rows with equal sets
   form a class; from here on a class stands for all its copies.
2. One permutation: the hashes fall into ``BINS`` bins by their leading bits, a bin's value
   is its smallest hash. Empty bins borrow from a bin that a second hash picks, again and
   again until one isn't empty (optimal densification). ``BAND`` bins make a band.
3. Classes that share a band meet in a bucket. In each, the class met most often elsewhere is
   the centre, and only (member, centre) pairs become candidates: a star instead of all pairs.
4. Candidates are confirmed on their full sets, and links are joined to components.
5. In buckets of up to ``FEW`` classes all pairs are candidates. A larger one whose members are
   in several components isn't settled, since members may be linked though neither is linked
   to the centre. Classes of such buckets form a family with the centre they know that is met
   most. In a family, those outside its largest component are compared with all others by matrix
   products of blocks: exact counts of shared shingles, of which only links that join
   components are returned. What is still unsettled gets new centres, and so other families,
   ``STARS`` times in all. Work in a family grows with its size times those outside its
   largest component; no pairs are written out.
6. Buckets that are still open then are finished exactly: those outside a bucket's largest
   settled group (one component, or one family of any turn) are compared with all its members
   in the same blocks, so that all classes that share a bucket are compared or joined.

A pair of similarity 0.8 shares no bucket with probability (1 - 0.8**4)**32 < 1e-7.

Nulls: a null text is empty; empty sets are linked with nothing. A null doc_id is never
linked and is kept. Rows that share a doc_id are one document. Texts are read whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .bpe import map_texts
from .graph import components

BIN_BITS = 7
BINS = 1 << BIN_BITS
BAND = 4
SIMILARITY = 80  # per cent
STARS = 3
FEW = 6
BLOCK_OUTSIDE, BLOCK_ALL = 512, 1024
SLICE = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than a shingle has, one for them all."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    data = _LOWER[data]
    gap = _SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    text_ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.empty(0, np.int64)
    upto = np.searchsorted(starts, text_ends)  # words up to the end of each text
    out, at = [], 0
    for end in upto.tolist():
        own = word[at:end]
        at = end
        n = len(own) - words + 1
        if n < 1:
            k = len(own)
            h = np.zeros(1 if k else 0, np.uint64)
            for i in range(k):
                h = mix(h * np.uint64(31) + own[i : i + 1])
        else:
            h = np.zeros(n, np.uint64)
            for i in range(words):
                h = mix(h * np.uint64(31) + own[i : i + n])
        out.append(np.unique(h))
    return out


def _borrowing() -> np.ndarray:
    """For each bin, the bins it tries to borrow from, in order; all of them come up."""
    rng = np.random.default_rng(0x5EED)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


BORROW = _borrowing()
LOWS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)


def signature(sorted_set: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a set that isn't empty."""
    at = np.searchsorted(sorted_set, LOWS)
    safe = np.minimum(at, len(sorted_set) - 1)
    value = sorted_set[safe]
    full = (at < len(sorted_set)) & (value >> np.uint64(64 - BIN_BITS) == np.arange(BINS, dtype=np.uint64))
    if full.all():
        return value
    empty = np.flatnonzero(~full)
    source = BORROW[empty, np.argmax(full[BORROW[empty]], axis=1)]
    value = value.copy()
    value[empty] = value[source]
    return value


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, BAND)
    h = np.arange(len(rows), dtype=np.uint64) + np.uint64(1)
    for i in range(BAND):
        h = mix(h * np.uint64(31) + rows[:, i])
    return h.view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_key binary, bands array<long>) of each row of ``docs`` (doc_id, text)."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def work(batch: pa.RecordBatch) -> dict[str, Any]:
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        return {
            "doc_id": batch.column("doc_id"),
            "n_shingles": [len(s) for s in sets],
            "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "bands": [bands(signature(s)) if len(s) else None for s in sets],
        }

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), "text", schema, work, SLICE)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles binary) of each row of ``docs`` (doc_id, text)."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def work(batch: pa.RecordBatch) -> dict[str, Any]:
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        return {"node": batch.column("doc_id"), "shingles": [s.tobytes() for s in sets]}

    return map_texts(docs, "text", schema, work, SLICE)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (p, q) if len(p) < len(q) else (q, p)
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * shared >= similarity * (len(p) + len(q) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def alike_in_size(similarity: int):
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * similarity


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets ``a`` shares with each of ``b``, by matrix products over columns of common elements."""
    left, right = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(common):
        return out

    def spots(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        here = common[column] == flat
        return row[here], column[here]

    (ra, ca), (rb, cb) = spots(left, a), spots(right, b)
    for at in range(0, len(common), 4096):
        x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        for grid, r, c in ((x, ra, ca), (y, rb, cb)):
            own = (c >= at) & (c < at + 4096)
            grid[r[own], c[own] - at] = 1
        out += x @ y.T
    return out


def family_links(rows: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(u, v) that join components inside families; ``rows`` has family, node, component and groups.

    ``groups`` are the node's component and what else holds only nodes that need no comparison with one another.
    """
    parts = rows.select("family", F.posexplode("groups").alias("kind", "group")).where("group IS NOT NULL").groupBy("family", "kind", "group").agg(F.count(F.lit(1)).alias("n"))
    per = parts.groupBy("family").agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("all"), F.max(F.struct("n", "kind", F.col("group").alias("main"))).alias("m"))
    per = per.select("family", "all", "m.kind", "m.main", (F.col("all") - F.col("m.n")).alias("outside")).where("outside > 0")
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    per = per.select("family", "kind", "main", blocks("outside", BLOCK_OUTSIDE).alias("n_out"), blocks("all", BLOCK_ALL).alias("n_all"))
    held = rows.join(per, "family").join(sets, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = held.where(~F.get("groups", "kind").eqNullSafe(F.col("main"))).withColumn("x", own("n_out")).withColumn("y", each("n_all"))
    everyone = held.withColumn("y", own("n_all")).withColumn("x", each("n_out"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            left, right = ([np.frombuffer(x, np.uint64) for x in t["shingles"]] for t in (a, b))
            shared = shared_counts(left, right)
            sizes = np.array([len(x) for x in left], np.float32)[:, None] + np.array([len(x) for x in right], np.float32)[None, :]
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            u, v = a["node"].to_numpy(), b["node"].to_numpy()
            cu, cv = a["component"].to_numpy(), b["component"].to_numpy()
            for i, j in zip(*np.nonzero(100 * shared >= similarity * (sizes - shared))):
                p, q = top(int(cu[i])), top(int(cv[j]))
                if p != q:
                    up[p] = q
                    out.append((int(u[i]), int(v[j])))
        return pd.DataFrame(out, columns=["u", "v"])

    keys = ("family", "x", "y")
    pick = lambda t: t.select(*(F.col(c).alias(c) for c in (*keys, "node", "component", "shingles"))).groupBy(*keys)
    return pick(outside).cogroup(pick(everyone)).applyInPandas(compare, "u long, v long")


def joined_labels(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels (node, component) after the links ``found`` (u, v); links between components so far are enough to join them."""
    if labels is None:
        return components(found)
    side = lambda n, c: labels.select(F.col("node").alias(n), F.col("component").alias(c))
    ends = found.join(side("u", "a"), "u", "left").join(side("v", "b"), "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    merged = components(ends)
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("further"))
    now = labels.join(moved, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    return store.stage(now.unionByName(merged.join(labels.select("node"), "node", "left_anti")), "labels")


def unsettled(large: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members, with their component, of buckets that hold several components."""
    if labels is None:
        return large.withColumn("component", F.col("node"))
    now = large.join(labels, "node", "left").select("band", "node", "n", "met", F.coalesce("component", "node").alias("component"))
    mixed = now.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band")
    return store.stage(now.join(mixed, "band"), "open-buckets")


def link(classes: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame | None:
    """Components (node, component) of linked classes; ``classes`` has node, n (set size) and bands. None if nothing is linked."""
    rows = classes.select("node", "n", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = store.stage(rows.join(buckets, "band"), "bucket-members")
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    members = store.stage(members.join(met, "node").select("band", "node", "n", "met", "size"), "bucket-members")
    nodes = members.select(F.col("node").alias("doc_id")).distinct()
    # the ids are hashed, the texts stream past
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = store.stage(full_sets(texts.join(nodes.hint("shuffle_hash"), "doc_id"), words).groupBy("node").agg(F.max("shingles").alias("shingles")), "shingle-sets")
    few = members.where(F.col("size") <= FEW)
    other = few.select("band", F.col("node").alias("v"), F.col("n").alias("m"))
    pairs = few.join(other, "band").where((F.col("node") < F.col("v")) & alike_in_size(similarity)).select(F.col("node").alias("u"), "v")
    large = members.where(F.col("size") > FEW).drop("size")
    live, labels, used, families = unsettled(large, None), None, None, []
    for turn in range(STARS):
        free = live if used is None else live.join(used, ["band", "node"], "left_anti")
        first = F.col("met") if turn % 2 == 0 else F.xxhash64("node", F.lit(turn))
        best = free.groupBy("band").agg(F.max(F.struct(first.alias("first"), (-F.col("node")).alias("minus"), F.col("n").alias("m"), "component")).alias("c"))
        centres = store.stage(best.select("band", (-F.col("c.minus")).alias("centre"), F.col("c.m").alias("m"), F.col("c.component").alias("own"), F.col("c.first").alias("first")), "centres")
        now_used = centres.select("band", F.col("centre").alias("node"))
        used = now_used if used is None else used.unionByName(now_used)
        rays = live.join(centres, "band").where((F.col("component") != F.col("own")) & alike_in_size(similarity))
        rays = rays.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v"))
        found = store.stage(confirmed((rays if turn else rays.unionByName(pairs)).distinct(), sets, similarity), "links")
        if found.limit(1).count():
            labels = joined_labels(labels, found)
        live = unsettled(large, labels)
        if not live.limit(1).count():
            break
        family = live.join(centres.select("band", "centre", "first"), "band").groupBy("node").agg(F.max(F.struct("first", "centre")).alias("c"), F.first("component").alias("component"))
        family = store.stage(family.select(F.col("c.centre").alias("family"), "node", "component"), "families")
        families.append(family.select("node", F.col("family").alias(f"family{turn}")))
        found = store.stage(family_links(family.withColumn("groups", F.array("component")), sets, similarity), "links")
        if found.limit(1).count():
            labels = joined_labels(labels, found)
            live = unsettled(large, labels)
            if not live.limit(1).count():
                break
    else:
        # two that were in one family have been compared, whatever buckets they share
        for turn in families:
            live = live.join(turn, "node", "left")
        rows = live.select(F.col("band").alias("family"), "node", "component", F.array("component", *(f"family{turn}" for turn in range(STARS))).alias("groups"))
        found = store.stage(family_links(store.stage(rows, "open-buckets"), sets, similarity), "links")
        if found.limit(1).count():
            labels = joined_labels(labels, found)
    return labels


def near_duplicates(docs: DataFrame, words: int = 4, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sigs = store.stage(signatures(docs, words), "signatures")
    named = sigs.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = store.stage(classes, "classes")
    labels = link(classes.select("node", "n", "bands"), docs, words, similarity)
    facts = classes.select("set_key", "node", "copies")
    if labels is not None:
        facts = facts.join(labels.groupBy("node").agg(F.min("component").alias("component")), "node", "left").select("set_key", "copies", F.coalesce("component", "node").alias("component"))
    else:
        facts = facts.select("set_key", "copies", F.col("node").alias("component"))
    facts = store.stage(facts, "components")
    found = store.attach(named.drop("bands"), facts, "set_key", "copies", named.count())
    rest = sigs.where("set_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = found.select("doc_id", "n_shingles", "component").unionByName(rest)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one document of each component, and rows without an id."""
    gone = store.stage(near_duplicates(docs, words, similarity).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["__gone"], "left_anti")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(store.table(spark, sf_dir, "documents", "doc_id", "text"), words=4)


OP4_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, k, k + 3), ' ') END AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
