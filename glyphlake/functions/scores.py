"""Scores that look at a pixel's surroundings, as numpy kernels behind a registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Bitmap = np.ndarray


def aligned(a: Bitmap, b: Bitmap) -> tuple[Bitmap, Bitmap]:
    """Both on the least common canvas on which their centres fall together."""
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    middle = h // 2, (w - 1) // 2

    def put(m: Bitmap) -> Bitmap:
        out = np.zeros((h, w), np.uint8)
        y, x = middle[0] - m.shape[0] // 2, middle[1] - (m.shape[1] - 1) // 2
        out[max(0, y) : y + m.shape[0], max(0, x) : x + m.shape[1]] = m[max(0, -y) :, max(0, -x) :][: h - max(0, y), : w - max(0, x)]
        return out

    return put(a), put(b)


def crowded(errors: Bitmap) -> int:
    """Each set pixel counts one and one more for each of its eight neighbours that is set."""
    padded = np.pad(errors.astype(np.int64), 1)
    h, w = errors.shape
    around = sum(padded[y : y + h, x : x + w] for y in range(3) for x in range(3))
    return int((around * errors).sum())


def _black(a: Bitmap, b: Bitmap) -> float:
    return 9 * ((int(a.sum()) + int(b.sum())) // 2)


def xor(a: Bitmap, b: Bitmap) -> float:
    a, b = aligned(a, b)
    return float((a != b).mean())


def weighted_xor(a: Bitmap, b: Bitmap) -> float:
    a, b = aligned(a, b)
    black = _black(a, b)
    return crowded((a != b).astype(np.uint8)) / black if black else float("nan")


def weighted_and_not(a: Bitmap, b: Bitmap) -> float:
    a, b = aligned(a, b)
    black = _black(a, b)
    return (crowded(a & (1 - b)) + crowded(b & (1 - a))) / black if black else float("nan")


def entropy(a: Bitmap, ref: Bitmap) -> float:
    a, ref = aligned(a, ref)
    black, white = int(ref.sum()), int((1 - ref).sum())
    if not black or not white:
        return float("nan")

    def part(k: int, n: int) -> float:
        p = k / n
        return 0.0 if p in (0, 1) else -n * (p * np.log(p) + (1 - p) * np.log(1 - p))

    return float((part(int((ref & (1 - a)).sum()), black) + part(int((a & (1 - ref)).sum()), white)) / a.size)


def labelled(mask: Bitmap) -> tuple[np.ndarray, int]:
    """4-connected components, numbered from 1 in order of their first pixel."""
    out = np.zeros(mask.shape, np.int32)
    n = 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        out[y, x] = n
        todo = [(int(y), int(x))]
        while todo:
            r, c = todo.pop()
            for p, q in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not out[p, q]:
                    out[p, q] = n
                    todo.append((p, q))
    return out, n


def clustered(a: Bitmap, b: Bitmap, small: int = 2, large: int = 4) -> float:
    """1 if pixels that differ touch in a cluster over the limit (``small`` for symbols up to 12 pixels either way), else their share."""
    limit = small if a.shape[0] <= 12 and a.shape[1] <= 12 else large
    a, b = aligned(a, b)
    differ = a != b
    labels, n = labelled(differ)
    if n and np.bincount(labels.ravel())[1:].max() > limit:
        return 1.0
    return float(differ.mean())


def local(a: Bitmap, b: Bitmap) -> float | None:
    """Pixels that differ, None if they touch too much: at all in symbols up to 12 pixels, more than once in larger ones, where each counts twice."""
    strict = a.shape[0] <= 12 and a.shape[1] <= 12
    a, b = aligned(a, b)
    differ = (a != b).astype(np.int64)
    p = np.pad(differ, 1)
    beside = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) * differ
    if beside.max(initial=0) > (0 if strict else 1):
        return None
    return float(differ.sum() * (1 if strict else 2))


def after_unification(a: Bitmap, b: Bitmap) -> float:
    """Share of pixels that differ once isolated differences are put right."""
    from glyphlake.operators.extract import isolated_differences

    a, b = aligned(a, b)
    differ = a != b
    return float((differ & ~isolated_differences(differ)).mean())


REGISTRY: dict[str, Callable[[Bitmap, Bitmap], float]] = {"XOR": xor, "WXOR": weighted_xor, "WAN": weighted_and_not, "ENT": entropy, "FAST": clustered}


def on_pairs(marks: DataFrame, pairs: DataFrame, name: str, width: int) -> DataFrame:
    """(i, j, score) of ``pairs`` (i, j) of ``marks`` (mark_id, bits of rows of ``width``), in Arrow batches."""
    kernel = REGISTRY[name]
    own = lambda n: marks.select(F.col("mark_id").alias(n), F.col("bits").alias(f"bits_{n}"))
    rows = pairs.select("i", "j").join(own("i"), "i").join(own("j"), "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [kernel(np.asarray(a, np.uint8).reshape(-1, width), np.asarray(b, np.uint8).reshape(-1, width)) for a, b in zip(batch["bits_i"], batch["bits_j"])]
            yield pd.DataFrame({"i": batch["i"], "j": batch["j"], "score": np.array(found, float)})

    return rows.mapInPandas(run, "i long, j long, score double")
