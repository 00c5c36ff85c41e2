"""Extraction of marks from stripes, and the relational steps around it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.scores import labelled

# --- relational forms


def centroid(bits: Column, width: int, x: str, y: str) -> list[Column]:
    """Mean position of the black pixels, cut to whole pixels; null if there is none."""
    black = F.aggregate(bits, F.lit(0), lambda n, b: n + b)
    spots = F.transform(bits, lambda b, k: F.struct(b.alias("b"), k.alias("k")))
    sum_x = F.aggregate(spots, F.lit(0), lambda n, s: n + s["b"] * (s["k"] % width))
    sum_y = F.aggregate(spots, F.lit(0), lambda n, s: n + s["b"] * F.floor(s["k"] / width).cast("int"))
    mean = lambda total: F.when(black > 0, F.floor(total / black).cast("int"))
    return [mean(sum_x).alias(x), mean(sum_y).alias(y)]


def is_speck(width: Column, height: Column) -> Column:
    return (width <= 2) & (height <= 2)


def typical(rows: DataFrame, column: str) -> DataFrame:
    """(value, n): the most frequent value, the smallest of equally frequent ones."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(1)


def split_row(rows: DataFrame, splits: int) -> DataFrame:
    """(stripe_height, n): of the page's rows (row, n black pixels) near a ``splits``-th of its height, the emptiest, looking down first."""
    page = rows.agg(F.min("row").alias("first"), (F.max("row") - F.min("row") + 1).alias("height"))
    nominal = F.floor(F.col("height") / splits)
    reach = F.floor(nominal / 16)
    steps = page.select("first", nominal.alias("nominal"), F.explode(F.sequence(-reach, reach)).alias("step"))
    seen = steps.withColumn("row", F.col("first") + F.col("nominal") + F.col("step")).join(rows, "row", "left")
    order = (F.coalesce("n", F.lit(0)), F.when(F.col("step") >= 0, 0).otherwise(1), F.abs("step"))
    return seen.orderBy(*order).limit(1).select((F.col("nominal") + F.col("step")).alias("stripe_height"), F.coalesce("n", F.lit(0)).alias("n"))


def first_enclosing(rows: DataFrame, key: str, by: str, at: str, reach: int, x: str, width: Column) -> DataFrame:
    """Each row with the first later one of its group within ``reach`` of ``at`` that encloses its ``x``: (key, stem).

    The range join is an equi-join: ``at`` is cut into cells of ``reach``, and a row looks into its own cell and the two beside it.
    """
    cell = F.floor(F.col(at) / reach)
    dots = rows.select(key, by, F.col(at).alias("at"), F.col(x).alias("x"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    stems = rows.select(F.col(key).alias("stem"), by, F.col(at).alias("stem_at"), F.col(x).alias("left"), (F.col(x) + width).alias("right"), cell.alias("cell"))
    found = dots.join(stems, [by, "cell"]).where((F.col("stem") > F.col(key)) & (F.abs(F.col("stem_at") - F.col("at")) <= reach) & (F.col("left") < F.col("x")) & (F.col("x") < F.col("right")))
    return rows.select(key).join(found.groupBy(key).agg(F.min("stem").alias("stem")), key, "left")


def words(rows: DataFrame, by: list[str], x: str, key: str, space: int) -> DataFrame:
    """``rows`` with word: letters of a line in order, a new word after each gap over ``space``."""
    line = Window.partitionBy(*by).orderBy(x, key)
    new = (F.col(x) - F.lag(x).over(line) > space).cast("int")
    return rows.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn("word", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def letter_space(gaps: dict[int, int]) -> int:
    """The widest gap inside a word: going up from the most frequent one, the last that is still a 64th as frequent."""
    if not gaps:
        return 0
    most = max(gaps.values())
    start = min(g for g, n in gaps.items() if n == most)
    wide = [g for g in gaps if g >= start and gaps[g] * 64 >= most]
    return max(wide)


# --- kernels over one stripe


@dataclass
class Mark:
    x: int
    y: int
    bitmap: np.ndarray
    holes: int = 0

    @property
    def width(self) -> int:
        return self.bitmap.shape[1]

    @property
    def height(self) -> int:
        return self.bitmap.shape[0]

    @property
    def speck(self) -> bool:
        return self.width <= 2 and self.height <= 2

    @property
    def bottom(self) -> int:
        return self.y + self.height - 1

    def aligned_at(self, centroid: bool) -> tuple[int, int]:
        if centroid and self.bitmap.any():
            ys, xs = np.nonzero(self.bitmap)
            return int(xs.mean()), int(ys.mean())
        return (self.width - 1) // 2, self.height // 2


def holes(bitmap: np.ndarray) -> int:
    """White regions inside; none are counted in shapes over five times longer than wide."""
    h, w = bitmap.shape
    if w > 5 * h or h > 5 * w:
        return 0
    return labelled(np.pad(bitmap, 1) == 0)[1] - 1


#: Right, down, left, up.
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def contour_box(page: np.ndarray, y: int, x: int) -> tuple[int, int, int, int]:
    """The box of a walk around a component with the left hand on its edge, from a seed back to it; ``page`` has a white border.

    The walk ends where it first meets the seed, so a seed that is a cut pixel hides what hangs on its other side.
    """
    top, left, bottom, right = y, x, y, x
    if not any(page[y + dy, x + dx] for dy, dx in STEPS):
        return top, left, bottom, right
    heading, r, c = 0, y, x
    while True:
        for turn in (-1, 0, 1, 2):  # left, ahead, right, back
            way = (heading + turn) % 4
            if page[r + STEPS[way][0], c + STEPS[way][1]]:
                break
        heading, r, c = way, r + STEPS[way][0], c + STEPS[way][1]
        top, left, bottom, right = min(top, r), min(left, c), max(bottom, r), max(right, c)
        if (r, c) == (y, x):
            return top, left, bottom, right


def extract_marks(stripe: np.ndarray, mode: str = "reference") -> list[Mark]:
    """Marks of a stripe in raster order of their seeds. ``connected``: whole 4-connected components; ``reference``: what lies in the contour's box."""
    page = np.pad(stripe.astype(bool), 1)
    out = []
    for y, x in zip(*np.nonzero(page)):
        if not page[y, x]:
            continue  # taken meanwhile
        box = contour_box(page, y, x) if mode == "reference" else (0, 0, page.shape[0] - 1, page.shape[1] - 1)
        todo, taken = [(int(y), int(x))], []
        page[y, x] = False
        while todo:
            r, c = todo.pop()
            taken.append((r, c))
            for dy, dx in STEPS:
                p, q = r + dy, c + dx
                if box[0] <= p <= box[2] and box[1] <= q <= box[3] and page[p, q]:
                    page[p, q] = False
                    todo.append((p, q))
        spots = np.array(taken)
        low = spots.min(axis=0) if mode == "connected" else np.array(box[:2])
        high = spots.max(axis=0) if mode == "connected" else np.array(box[2:])
        bitmap = np.zeros(high - low + 1, np.uint8)
        bitmap[tuple((spots - low).T)] = 1
        out.append(Mark(int(low[1]) - 1, int(low[0]) - 1, bitmap, holes(bitmap)))
    return out


def paint(canvas: np.ndarray, bitmap: np.ndarray, x: int, y: int) -> None:
    """Adds a bitmap's black pixels, without what lies outside."""
    top, left = max(0, -y), max(0, -x)
    part = bitmap[top : max(top, canvas.shape[0] - y), left : max(left, canvas.shape[1] - x)]
    canvas[y + top : y + top + part.shape[0], x + left : x + left + part.shape[1]] |= part


def attach_dots(marks: list[Mark]) -> list[Mark]:
    """Dots are joined with their stems: the first later mark that starts within a typical height below, encloses the dot and is no dot.

    A stem is used once. The joined mark takes the dot's place in the order and keeps its count of holes.
    """
    if not marks:
        return []
    mode = lambda v: int(np.argmax(np.bincount(v)))  # noqa: E731  the smallest of equally frequent ones
    tall, wide = mode([m.height for m in marks]), mode([m.width for m in marks])
    dot = lambda m: not m.speck and m.width <= wide // 3 and m.height <= tall // 3
    out, used = list(marks), set()
    for i, d in enumerate(out):
        if i in used or not dot(d):
            continue
        stem = next((k for k in range(i + 1, len(out)) if out[k].y < d.y + tall and out[k].x < d.x < out[k].x + out[k].width and not dot(out[k])), None)
        if stem is None or stem in used:
            continue
        s = out[stem]
        x, right = min(d.x, s.x), max(d.x + d.width, s.x + s.width)
        canvas = np.zeros((s.bottom + 1 - d.y, right - x), np.uint8)
        for m in (d, s):
            paint(canvas, m.bitmap, m.x - x, m.y - d.y)
        out[i] = Mark(x, d.y, canvas, d.holes)
        used.add(stem)
    return [m for k, m in enumerate(out) if k not in used]


def smooth_edges(stripe: np.ndarray) -> np.ndarray:
    """Single pixels that stick out of or into a straight edge are flipped, in raster order, so that later ones see the flips."""
    page = np.pad(stripe.astype(np.uint8), 1)
    ring = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
    for y in range(1, page.shape[0] - 1):
        for x in range(1, page.shape[1] - 1):
            around = [page[y + dy, x + dx] for dy, dx in ring]
            own = page[y, x]
            if sum(a == own for a in around) == 3 and any(all(around[(k + t) % 8] == own for t in range(3)) for k in (0, 2, 4, 6)):
                page[y, x] = 1 - own
    return page[1:-1, 1:-1]


def isolated_differences(differ: np.ndarray) -> np.ndarray:
    """Clusters of one or two pixels with nothing else that differs around them."""
    padded = np.pad(differ.astype(bool), 1)
    grown = np.zeros_like(padded)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            grown |= np.roll(padded, (dy, dx), (0, 1))
    out = np.zeros_like(differ, bool)
    # touching also by corners counts as one cluster here
    labels = np.zeros(differ.shape, np.int32)
    n = 0
    for y, x in zip(*np.nonzero(differ)):
        if labels[y, x]:
            continue
        n += 1
        labels[y, x] = n
        todo, own = [(int(y), int(x))], []
        while todo:
            r, c = todo.pop()
            own.append((r, c))
            for p in range(max(0, r - 1), min(differ.shape[0], r + 2)):
                for q in range(max(0, c - 1), min(differ.shape[1], c + 2)):
                    if differ[p, q] and not labels[p, q]:
                        labels[p, q] = n
                        todo.append((p, q))
        straight = len(own) == 1 or len(own) == 2 and abs(own[0][0] - own[1][0]) + abs(own[0][1] - own[1][1]) == 1
        if straight:
            for spot in own:
                out[spot] = True
    return out


def unify_shape(bitmap: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, bool]:
    """``bitmap`` without its isolated differences from a reference of its size, and whether it then equals the reference."""
    differ = bitmap != ref
    out = bitmap.copy()
    out[isolated_differences(differ)] ^= 1
    return out, bool((out == ref).all())


MARKS = (
    "doc_id string, page_no int, split_no int, mark_id int, ul_x int, ul_y int, ref_x int, ref_y int, c_x int, c_y int,"
    " width int, height int, holes int, n_black int, speck boolean, bitmap binary"
)


def extract(stripes: DataFrame, mode: str = "reference", centroid_align: bool = False, smooth: bool = False, dots: bool = True) -> DataFrame:
    """Marks of each of ``stripes`` (doc_id, page_no, split_no, width, height, px: a byte a pixel); specks are marked and have no mark_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MARKS.split(", ")]
        for batch in batches:
            for s in batch.itertuples(index=False):
                px = np.frombuffer(s.px, np.uint8).reshape(s.height, s.width)
                found = extract_marks(smooth_edges(px) if smooth else px, mode)
                specks = [m for m in found if m.speck]
                kept = [m for m in found if not m.speck]
                rows = []
                for k, m in [*enumerate(attach_dots(kept) if dots else kept), *((None, m) for m in specks)]:
                    c = m.aligned_at(centroid_align)
                    rows.append((s.doc_id, s.page_no, s.split_no, k, m.x, m.y, m.x, m.bottom, *c, m.width, m.height, m.holes, int(m.bitmap.sum()), k is None, m.bitmap.tobytes()))
                yield pd.DataFrame(rows, columns=names).astype({"mark_id": "Int32"})

    return stripes.select("doc_id", "page_no", "split_no", "width", "height", "px").mapInPandas(run, MARKS)
