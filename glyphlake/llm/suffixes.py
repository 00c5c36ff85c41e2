"""Removal of repeated passages by digits of sampled suffixes.

What repeats is every string of ``LENGTH`` bytes that starts in two places. Suffixes are
told apart only through that many bytes, in passes from coarse keys to fine ones; a pass keeps the groups that
hold two suffixes or more, and what is equal through the last pass is exactly the repeated strings.

This is not a sort of all suffixes by most significant digits: one pass of that takes a row through the shuffle for
each byte of text, many times the input and beyond the disk that a run may use (README has the
figures). Instead suffixes are sampled. A window's first key is its anchor, the ``DIGIT``-byte string inside
it that has the least hash (the last one, if equal). Equal windows have equal anchors in equal
places, and neighbouring suffixes share theirs, so one row stands for a run of suffixes
(about one row for 80 suffixes). Groups are made by hashing, not by ordering:

1. By anchor. Runs whose anchor occurs once are done: none of their windows repeats.
2. By all bytes that the windows of a run cover. Runs equal through them repeat entirely.
3. Runs that share an anchor and differ elsewhere. A group of up to ``GROUP`` different
   runs is compared byte by byte on both sides of the anchor. In larger groups runs are cut into
   pieces of ``STEP`` windows, pieces are grouped by all their bytes, and what is left by
   single windows. Texts are fetched for these runs alone.

Strings are equated by 128 bits at least (the anchor's 64 and 64 more of the run, piece or
window), and rows are named by 128 bits of doc_id and text.

An anchor may belong to a third of all rows: counts combine on the map side, anchors and runs that are hot are
found by their counts and joined by broadcast (there are at most 1/HOT_SHARE of them), and pieces of
large groups are dealt by anchor and content. Texts travel compressed, and only intervals are gathered
for each document.

Nulls: a null text is empty. Rows with equal doc_id and text are both documents, and repeat
each other. Texts shorter than LENGTH lose nothing; longer ones are read whole. An empty table
gives an empty result; a null doc_id is kept; extra columns are ignored or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .bpe import map_texts
from .minhash import mix, powers

LENGTH = 200
DIGIT = 40
#: Different runs of one anchor that are compared in one piece; larger groups go window by window.
GROUP = 48
STEP = 16
#: Bytes of text hashed at once.
SLICE = 600_000
_SPOT_BITS = 24
_SPOTS = np.uint64((1 << _SPOT_BITS) - 1)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by minima from both ends of blocks of ``w``."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


class Hashes:
    """Hashes of any substring of ``data`` from one pass."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def rolling(self, length: int) -> np.ndarray:
        n = len(self.total) - length
        return mix((self.total[length:] - self.total[:n]) * self.down[:n] + np.uint64(length))


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, digit: int = DIGIT) -> tuple[np.ndarray, ...]:
    """Runs of suffixes in texts that lie at ``starts`` to ``ends`` in ``data``.

    Returns arrays: text number, first and last window start, anchor position (all within
    the text), hash of the anchor, hash of all the bytes of the run.
    """
    nothing = tuple(np.empty(0, np.int64) for _ in range(6))
    if len(data) < length:
        return nothing
    hashes = Hashes(data)
    key = hashes.rolling(digit)
    width = length - digit + 1
    spots = np.arange(len(key), dtype=np.uint64) & _SPOTS
    packed = (key & ~_SPOTS) | (_SPOTS - spots)  # of equal hashes the last one is the least
    least = window_min(packed, width)
    at = np.arange(len(least), dtype=np.int64)
    spot = (_SPOTS - (least & _SPOTS)).astype(np.int64)
    anchor = at + ((spot - at) & int(_SPOTS))  # spots wrap around in very long data
    owner = np.searchsorted(ends, at, "right")
    inside = (owner < len(ends)) & (at + length <= ends[np.minimum(owner, len(ends) - 1)]) & (at >= starts[np.minimum(owner, len(ends) - 1)])
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    a, text = anchor[lo], owner[lo]
    whole = hashes.of(lo, hi + length)
    whole = mix(whole + (a - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = starts[text]
    return text, lo - base, hi - base, a - base, key[a], whole


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one array, and where each starts and ends."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.empty(0, np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts, ends


#: The name of a row: 128 bits of its content, so that it may be recomputed anywhere.
ROW = ["row", "twin"]


def row_key():
    return F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "doc_id", "text").alias("twin")


def run_rows(docs: DataFrame, length: int, digit: int) -> DataFrame:
    """(anchor, whole, row, twin, place) for each run; place packs first window start, number of windows and anchor offset."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "whole", *ROW, "place")])

    def work(batch: pa.RecordBatch) -> dict[str, Any]:
        long = [(k, t) for k, t in enumerate(x.as_buffer() if x.is_valid else b"" for x in batch.column("text").cast(pa.binary())) if len(t) >= length]
        rows = np.array([k for k, _ in long], np.int64)
        text, lo, hi, at, anchor, whole = runs(*laid_out([t for _, t in long]), length, digit)
        names = {c: batch.column(c).to_numpy()[rows[text]] if len(text) else text for c in ROW}
        return {"anchor": anchor.view(np.int64), "whole": whole.view(np.int64), **names, "place": (lo << 20) | ((hi - lo) << 10) | (at - lo)}

    return map_texts(docs.select(*row_key(), "text"), "text", schema, work, SLICE)


def squeezed(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) with row, twin and squeezed (the compressed text) in place of text."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ROW), T.StructField("squeezed", T.BinaryType())])

    def work(batch: pa.RecordBatch) -> dict[str, Any]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        packed = [z.compress(x.as_buffer() if x.is_valid else b"") for x in batch.column("text").cast(pa.binary())]
        return {n: batch.column(n) for n in schema.names[:-1]} | {"squeezed": packed}

    return map_texts(docs.select("*", *row_key()), "text", schema, work)


def fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (anchor, whole, row, twin, place, n, size) with bytes, all those that the run's windows cover."""
    asked = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("anchor", "whole", "place", "n", "size")).alias("runs"))  # a document's runs
    texts = squeezed(docs.select("doc_id", "text")).drop("doc_id").join(asked.hint("shuffle_hash"), ROW)
    names = ("anchor", "whole", *ROW, "place", "n", "size")
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in names), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                out: list[list] = [[] for _ in schema.names]
                for row, twin, packed, own in zip(*(part.column(c).to_pylist() for c in (*ROW, "squeezed", "runs")), strict=True):
                    text = z.decompress(packed)
                    for r in own:
                        lo, more = r["place"] >> 20, (r["place"] >> 10) & 1023
                        for column, value in zip(out, (r["anchor"], r["whole"], row, twin, r["place"], r["n"], r["size"], text[lo : lo + more + length]), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(out, [pa.int64()] * len(names) + [pa.binary()], strict=True)], schema.names)

    return texts.select(*ROW, "squeezed", "runs").mapInArrow(run, schema)


def shared_windows(members: list[dict], length: int) -> list[tuple[int, int, int, int]]:
    """(row, twin, first, last window start) of windows that runs of one anchor share, for members that stand alone (n of 1)."""
    # a column more on either side, in which all differ
    left = 1 + max(m["place"] & 1023 for m in members)
    right = 1 + max(len(m["bytes"]) - (m["place"] & 1023) for m in members)
    grid = np.empty((len(members), left + right), np.int16)
    grid[:] = (256 + np.arange(len(members)))[:, None]  # unlike any byte, and unlike each other
    for i, m in enumerate(members):
        off = left - (m["place"] & 1023)
        grid[i, off : off + len(m["bytes"])] = np.frombuffer(m["bytes"], np.uint8)
    out = []
    for i, m in enumerate(members):
        if m["n"] > 1:
            continue
        lo, more, off = m["place"] >> 20, (m["place"] >> 10) & 1023, m["place"] & 1023
        differ = np.delete(grid, i, axis=0) != grid[i]
        before, after = differ[:, :left][:, ::-1].argmax(axis=1), differ[:, left:].argmax(axis=1)
        # a window that starts o bytes before the anchor is shared if o <= before and length - o <= after
        near, far = np.maximum(length - after, off - more), np.minimum(before, off)
        for a, b in sorted(set(zip(near[near <= far].tolist(), far[near <= far].tolist(), strict=True))):
            out.append((m["row"], m["twin"], lo + off - b, lo + off - a))
    return out


def small_groups(found: DataFrame, length: int) -> DataFrame:
    grouped = found.groupBy("anchor").agg(F.collect_list(F.struct(*ROW, "place", "n", "bytes")).alias("members"))  # GROUP at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = [x for members in batch.column("members").slice(k, 500).to_pylist() for x in shared_windows(members, length)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], [*ROW, "first", "last"])

    return grouped.select("members").mapInArrow(run, "row long, twin long, first long, last long")


def pieces_of(found: DataFrame, length: int) -> DataFrame:
    """Runs cut into pieces of up to STEP windows, at the same distances from the anchor in every run: (anchor, row, twin, first, last, n, hull, bytes)."""
    names = ["anchor", *ROW, "first", "last", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                rows: list[list] = [[] for _ in range(len(names) + 1)]
                texts: list[bytes] = []
                for anchor, row, twin, place, n, data in zip(*(part.column(c).to_pylist() for c in ("anchor", *ROW, "place", "n", "bytes")), strict=True):
                    lo, more, off = place >> 20, (place >> 10) & 1023, place & 1023
                    at = 0
                    while at <= more:
                        upto = min(more, at + (off - at) % STEP)  # the distance to the anchor falls to a multiple of STEP
                        for column, value in zip(rows, (anchor, row, twin, lo + at, lo + upto, n, off - at), strict=True):
                            column.append(value)
                        texts.append(data[at : upto + length])
                        at = upto + 1
                if texts:
                    data, starts, ends = laid_out(texts)
                    hull = mix(Hashes(data).of(starts, ends) + np.array(rows[-1], np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:-1]), pa.array(hull.view(np.int64)), pa.array(texts, pa.binary())], [*names, "hull", "bytes"])

    return found.mapInArrow(run, ", ".join(f"{c} long" for c in (*names, "hull")) + ", bytes binary")


def large_groups(found: DataFrame, length: int) -> DataFrame:
    """Two more keys for groups of any size: pieces of neighbouring windows, equal as a whole, then, of those that aren't, each window.

    Equal windows have one anchor, so both keys go with it: 128 bits in all.
    """

    def windows_of(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    part = batch.slice(k, 1000)
                    data, starts, ends = laid_out(part.column("bytes").to_pylist())
                    counts = ends - starts - length + 1
                    if not len(counts):
                        continue
                    at = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    columns = {c: np.repeat(part.column(c).to_numpy(), counts) for c in names}
                    if "first" in columns:
                        columns["first"] = columns["first"] + at - np.repeat(starts, counts)
                    columns["window"] = Hashes(data).of(at, at + length).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

        return run

    def split(pieces: DataFrame, names: list[str]) -> DataFrame:
        return pieces.select(*names, "bytes").mapInArrow(windows_of(names), ", ".join(f"{c} long" for c in (*names, "window")))

    pieces = store.stage(pieces_of(found, length), "pieces-of-runs")
    equal = pieces.groupBy("anchor", "hull").agg(F.sum("n").alias("times")).where("times > 1").select("anchor", "hull")
    alone = pieces.where("n = 1")
    whole = alone.join(equal, ["anchor", "hull"]).select(*ROW, "first", "last")
    rest = alone.join(equal, ["anchor", "hull"], "left_anti")
    often = split(pieces, ["anchor", "n"]).groupBy("anchor", "window").agg(F.sum("n").alias("times")).where("times > 1").select("anchor", "window")
    single = split(rest, ["anchor", *ROW, "first"]).join(often, ["anchor", "window"])
    return whole.unionByName(single.select(*ROW, "first", F.col("first").alias("last")))


def repeated(docs: DataFrame, length: int = LENGTH, digit: int = DIGIT) -> DataFrame:
    """(row, twin, spans array<struct<start, end>>) of the rows of ``docs`` that hold repeated strings; spans may overlap."""
    rows = store.stage(run_rows(docs, length, digit), "runs")
    anchors = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    anchors = store.stage(anchors.where("times > 1").select("anchor", "times", (F.col("a") == F.col("b")).alias("alike")), "anchors")
    total = anchors.agg(F.sum("times")).first()[0] or 0
    shared = store.stage(store.attach(rows, anchors, "anchor", "times", total).drop("times"), "shared-anchors")
    first, more = F.expr("place >> 20"), F.expr("(place >> 10) & 1023")
    span = (*ROW, first.alias("first"), (first + more).alias("last"))
    full = shared.where("alike").select(*span)
    mixed = shared.where("NOT alike")
    wholes = mixed.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "place")).alias("one"))
    wholes = store.stage(wholes.select("anchor", "whole", "n", *(f"one.{c}" for c in ROW), "one.place"), "mixed-runs")
    total, different = wholes.agg(F.sum("n"), F.count(F.lit(1))).first()
    full = full.unionByName(store.attach(mixed, wholes.where("n > 1").select("anchor", "whole", "n"), ["anchor", "whole"], "n", total or 0).select(*span))
    sizes = store.stage(wholes.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")), "mixed-anchors")
    # rows repeated under one name bring the same bytes, which meet before they are shuffled
    found = fetched(docs, store.attach(wholes, sizes, "anchor", "size", different), length).dropDuplicates(["anchor", "whole"])
    found = store.stage(found, "run-bytes")
    windows = full.unionByName(small_groups(found.where(F.col("size") <= GROUP), length)).unionByName(large_groups(found.where(F.col("size") > GROUP), length))
    spans = windows.select(*ROW, F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end")).alias("span"))
    return store.stage(spans.groupBy(*ROW).agg(F.collect_set("span").alias("spans")), "spans")  # a document's spans, once each


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


def remove_repeats(docs: DataFrame, length: int = LENGTH, digit: int = DIGIT, whole_characters: bool = False) -> DataFrame:
    """``docs`` with n_bytes, removed (array of [start, end) byte spans) and kept (binary: what is left) in place of text.

    With ``whole_characters`` a character that is covered in part stays.
    """
    spans = repeated(docs.select("doc_id", "text"), length, digit)
    kept = [f for f in docs.schema.fields if f.name not in ("text", "n_bytes", "removed", "kept")]  # columns called so give way
    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(pair)), T.StructField("kept", T.BinaryType())])
    names = [f.name for f in kept]
    safe = {n: f"__{i}" for i, n in enumerate(names)}  # their columns may be called as ours are
    inner = docs.select(*(F.col(f"`{n}`").alias(safe[n]) for n in names), "doc_id", "text")
    joined = squeezed(inner).drop("doc_id").join(spans.hint("shuffle_hash"), ROW, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        z, arrow = zstandard.ZstdDecompressor(), to_arrow_schema(schema)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sizes, removed, left = [], [], []
                for packed, own in zip(part.column("squeezed").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    text = z.decompress(packed)
                    sizes.append(len(text))
                    cuts: list[dict] = []
                    if own:
                        a, b = merged(np.array([s["start"] for s in own]), np.array([s["end"] for s in own]))
                        for start, end in zip(a.tolist(), b.tolist(), strict=True):
                            if whole_characters:
                                while start < end and text[start] & 0xC0 == 0x80:
                                    start += 1
                                while start < end < len(text) and text[end] & 0xC0 == 0x80:
                                    end -= 1
                            if start < end:
                                cuts.append({"start": start, "end": end})
                    at, parts = 0, []
                    for c in cuts:
                        parts.append(text[at : c["start"]])
                        at = c["end"]
                    parts.append(text[at:])
                    removed.append(cuts)
                    left.append(b"".join(parts))
                columns = [part.column(safe[n]) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, arrow.field(n).type) for x, n in ((sizes, "n_bytes"), (removed, "removed"), (left, "kept")))], schema=arrow)

    return joined.select(*safe.values(), "squeezed", "spans").mapInArrow(run, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(store.table(spark, sf_dir, "documents", "doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
