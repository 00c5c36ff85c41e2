"""Best-fit packing of token sequences by linear grouping.

Documents become pieces of at most ``capacity`` tokens. All that the plan needs of them is
how many there are of each length, at most ``capacity`` numbers however large the corpus,
so the plan is made on the driver and the pieces never are collected:

1. Lengths over ``capacity // SMALL`` are large. In descending order they are dealt into
   ``GROUPS`` groups of equal cardinality and rounded up to the largest of their group.
2. Configurations of rounded lengths are optimised by the linear programme of cutting stock:
   the simplex method holds one configuration for each group, and a knapsack over the dual
   prices yields the next to enter, until none lowers the number of sequences. Each is used
   as often as the whole part of its share says.
   The pieces that this leaves, fewer than a sequence for each group, fill further
   configurations as far as a subset-sum table can.
3. Actual pieces take their group's places, longest first.
4. Small pieces, longest first, go where they fit best, by classes of equal free space.

Pieces of one length are interchangeable: they are numbered inside hash buckets of their
staged rows, bucket counts are summed up, and each piece finds its place in the plan by its number.

Nulls: a null text is empty and still has its end token; a null doc_id is kept. Repeated
rows are packed each. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .bpe import codec, default_vocabulary, map_texts

CAPACITY = 1024
END_ID = 2
#: Lengths over a SMALL-th of the capacity take part in the grouping.
SMALL = 4
#: Groups of equal cardinality that large lengths are rounded in; of the 767 lengths there may be, so many sizes are left at most.
GROUPS = 400
#: Pivots after which the programme's basis is taken as it is; any basis is a whole plan, only with more sequences.
MOST_PIVOTS = 20_000
TOLERANCE = 1e-7
#: Pieces that a bucket of the numbering is meant to hold.
BUCKET_ROWS = 100_000


def cut(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the token ids of ``docs`` (doc_id, text), each document closed by ``end_id``.

    A longer document is cut so that only its first piece is shorter than ``capacity``.
    """
    path = vocabulary or default_vocabulary()
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32"))])
    schema["piece"].dataType = T.IntegerType()

    def work(batch: pa.RecordBatch) -> dict[str, Any]:
        c = codec(path)
        rows, piece, start, length, crc = [], [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            ids = np.append(c.encode_plain(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
            at, k = 0, 0
            upto = len(ids) % capacity or capacity
            while at < len(ids):
                rows.append(row)
                piece.append(k)
                start.append(at)
                length.append(upto - at)
                crc.append(zlib.crc32(ids[at:upto].tobytes()))
                at, k, upto = upto, k + 1, upto + capacity
        return {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    return map_texts(docs.select("doc_id", "text"), "text", schema, work)


@dataclass
class Bins:
    """``count`` sequences that hold the same lengths: (length, pieces of it in each) in order."""

    count: int
    free: int
    holds: list[tuple[int, int]] = field(default_factory=list)

    def split(self, n: int) -> Bins:
        """Takes ``n`` of the sequences away."""
        self.count -= n
        return Bins(n, self.free, list(self.holds))

    def put(self, length: int, each: int) -> None:
        self.holds.append((length, each))
        self.free -= length * each


def grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, count] in descending order, cut into groups of equal cardinality."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out: list[list[list[int]]] = [[]]
    room = size
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            n = min(left, room)
            out[-1].append([length, n])
            left -= n
            room -= n
    return [g for g in out if g]


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Pieces of each size that are worth most together, of those that fit."""
    largest, smallest = int(sizes.max()), int(sizes.min())
    slots = capacity // smallest
    # what the pieces of the slots before are worth at most, by the space that may be left for them
    best, chosen = np.zeros(capacity - slots * smallest + 1), []
    for _ in range(slots):
        width = len(best) + smallest
        held = sliding_window_view(np.concatenate([np.full(largest, -np.inf), best]), width)[largest - sizes]
        worth = held + prices[:, None]
        pick = worth.argmax(axis=0)
        value = worth[pick, np.arange(width)]
        chosen.append(np.where(value > 0, pick, -1))
        best = np.maximum(value, 0)
    out, space = np.zeros(len(sizes)), capacity
    for pick in reversed(chosen):
        if pick[space] < 0:
            break
        out[pick[space]] += 1
        space -= sizes[pick[space]]
    return out


def shares(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The optimum of the linear programme: configurations (columns) and how often each is used, in fractions."""
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / columns.diagonal())
    # equal demands would let the simplex method go round in circles; slightly unequal ones don't
    apart = demand + 1e-4 * (1 + np.arange(len(sizes)) * 0.6180339887 % 1)
    used = inverse.diagonal() * apart
    for _ in range(MOST_PIVOTS):
        entering = best_configuration(sizes, inverse.sum(axis=0), capacity)
        held = np.flatnonzero(entering)
        along = (inverse[:, held] * entering[held]).sum(axis=1)  # a few columns: no need of a matrix product
        if along.sum() <= 1 + TOLERANCE:
            break
        ratio = np.where(along > TOLERANCE, used / np.where(along > TOLERANCE, along, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = entering
        pivot = along[out]
        along[out] = 0
        inverse[out] /= pivot
        used[out] /= pivot
        inverse -= np.outer(along, inverse[out])
        used = np.maximum(used - along * used[out], 0)
    return columns, np.maximum((inverse * demand).sum(axis=1), 0)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(times, [(group, pieces of it)]) until the demand is met; sizes descend."""
    if not sizes:
        return
    left = np.array(demand)
    columns, used = shares(np.array(sizes), left.astype(float), capacity)
    for column, times in zip(columns.T.astype(int), np.floor(used + TOLERANCE).astype(int), strict=True):
        held = np.flatnonzero(column)
        times = min(int(times), int((left[held] // column[held]).min()))
        if times:
            left -= times * column
            yield times, [(int(g), int(column[g])) for g in held]
    yield from filled(sizes, left.tolist(), capacity)


def filled(sizes: list[int], demand: list[int], capacity: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Configurations chosen one after another: each holds the largest size left and is filled as far as it can be."""
    first = 0
    while True:
        while first < len(sizes) and not demand[first]:
            first += 1
        if first == len(sizes):
            return
        room = capacity - sizes[first]
        # reach[c]: the group whose piece was added last to make the sum c; larger lengths are tried first
        reach = {0: (-1, 0)}
        for g in range(first, len(sizes)):
            n = demand[g] - (g == first)
            if sizes[g] > room or n <= 0:
                continue
            for total in list(reach):
                for k in range(1, n + 1):
                    c = total + k * sizes[g]
                    if c > room or c in reach:
                        break
                    reach[c] = (g, k)
            if room in reach:
                break
        c = max(reach)
        config = {first: 1}
        while c:
            g, k = reach[c]
            config[g] = config.get(g, 0) + k
            c -= k * sizes[g]
        times = min(demand[g] // k for g, k in config.items())
        for g, k in config.items():
            demand[g] -= k * times
        yield times, sorted(config.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[Bins]:
    """Sequences for ``counts`` pieces of each length."""
    bins = [Bins(counts[capacity], 0, [(capacity, 1)])] if counts.get(capacity) else []
    large = {n: c for n, c in counts.items() if capacity // small < n < capacity and c}
    runs = grouped(large, groups) if large else []
    open_bins: list[Bins] = []
    for times, config in configurations([g[0][0] for g in runs], [sum(n for _, n in g) for g in runs], capacity):
        todo = [Bins(times, capacity)]
        for g, k in config:
            for _ in range(k):
                done: list[Bins] = []
                for b in todo:
                    while b.count:
                        run = runs[g][0]
                        part = b.split(min(b.count, run[1]))
                        part.put(run[0], 1)
                        run[1] -= part.count
                        if not run[1]:
                            runs[g].pop(0)
                        done.append(part)
                todo = done
        open_bins += todo
    # large pieces may fit into what rounding and other configurations left
    by_free: dict[int, list[Bins]] = {}
    for b in open_bins:
        by_free.setdefault(b.free, []).append(b)
    for length in sorted((n for n in counts if n <= capacity // small and counts[n]), reverse=True):
        left = counts[length]
        for free in sorted(f for f in by_free if f >= length):
            each = free // length
            kept = []
            for b in by_free.pop(free):
                full = min(b.count, left // each)
                rest = left - full * each if full < b.count else 0
                if full:
                    part = b.split(full)
                    part.put(length, each)
                    by_free.setdefault(part.free, []).append(part)
                    left -= full * each
                if rest and b.count:
                    part = b.split(1)
                    part.put(length, rest)
                    by_free.setdefault(part.free, []).append(part)
                    left -= rest
                if b.count:
                    kept.append(b)
            if kept:
                by_free.setdefault(free, []).extend(kept)
            if not left:
                break
        if left:
            each = capacity // length
            for n, k in ((left // each, each), (1, left % each)):
                if n and k:
                    b = Bins(n, capacity)
                    b.put(length, k)
                    by_free.setdefault(b.free, []).append(b)
    return [*bins, *(b for free in sorted(by_free) for b in by_free[free])]


def places(bins: list[Bins]) -> dict[str, np.ndarray]:
    """The plan by length and number of the piece: rows (length, first, each, sequence, offset), sorted by length and first."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for b in bins:
        offset = 0
        for length, each in b.holds:
            first = used.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            used[length] = first + b.count * each
            offset += length * each
        sequence += b.count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T, strict=True))


def numbered(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``pieces``, staged, with number, from 0 among those of equal length; and how many there are of each length."""
    # a row's own number, so that repeated rows don't meet in one bucket
    staged = store.stage(pieces.withColumn("__at", F.monotonically_increasing_id()), "pieces")
    n = max(store.parallelism(pieces.sparkSession), staged.count() // BUCKET_ROWS)
    keyed = staged.withColumn("bucket", F.pmod(F.xxhash64("__at"), F.lit(n)))
    held = keyed.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    held = held.select("bucket", "length", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("__at"))
    out = keyed.withColumn("within", within).join(held, ["bucket", "length"])
    counts = {r["length"]: r["n"] for r in staged.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    return out.withColumn("number", F.col("before") + F.col("within") - 1).drop("bucket", "before", "within", "__at"), counts


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with doc_id, piece, start, length, ids_crc32) with their sequence_id and offset."""
    rows, counts = numbered(pieces)
    at = places(plan(counts, capacity))
    # a length and a number in one key, so that one binary search finds the place
    keys = (at["length"] << 48) + at["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            k = np.searchsorted(keys, (length << 48) + number, "right") - 1
            nth = number - at["first"][k]
            sequence = at["sequence"][k] + nth // at["each"][k]
            offset = at["offset"][k] + nth % at["each"][k] * length
            names = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = T.StructType([f for f in rows.schema.fields if f.name != "number"] + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")])
    return rows.mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut(store.table(spark, sf_dir, "documents", "doc_id", "text"))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
