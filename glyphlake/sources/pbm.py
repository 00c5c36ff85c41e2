"""Page images: packed bilevel files as tables and back, stripes, and helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "doc_id string, page_no int, width int, height int, raster binary"
STRIPES = "doc_id string, page_no int, split_no int, top_y int, width int, height int, px binary"
#: Fixed value: a path's folder and prefix, its number, its suffix.
NUMBERED = re.compile(r"^(.*?)(\d+)(\D*)\.pbm$")


def parse_header(data: bytes) -> tuple[int, int]:
    """Width and height; lines that are empty or begin with ``#`` are skipped."""
    if not data.startswith(b"P4"):
        raise ValueError("not a packed bilevel image")
    lines = (line for line in data[:4096].split(b"\n")[1:] if line.strip() and not line.startswith(b"#"))
    width, height = next(lines).split()[:2]
    return int(width), int(height)


def parse(data: bytes) -> tuple[int, int, bytes]:
    """The raster is what ends the file."""
    width, height = parse_header(data)
    size = -(-width // 8) * height
    return width, height, data[len(data) - size :]


def pixels(raster: bytes, width: int, height: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raster, np.uint8).reshape(height, -1), axis=1)[:, :width]


def write(bitmap: np.ndarray) -> bytes:
    return f"P4\n{bitmap.shape[1]} {bitmap.shape[0]}\n".encode() + np.packbits(bitmap.astype(np.uint8), axis=1).tobytes()


def page_path(first: str, page: int) -> str:
    """The file of a document's ``page``-th page, by the number in the first one's name; leading zeros are lost."""
    m = NUMBERED.match(first)
    if not m:
        raise ValueError(f"no number in {first}")
    return f"{m[1]}{int(m[2]) + page}{m[3]}.pbm"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Every image below ``path``: the document is what stands around the number in its name, the page that number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                m = NUMBERED.match(name)
                rows.append((m[1] + m[3] if m else name, int(m[2]) if m else 0, *parse(content)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pbm").load(path).select("path", "content")
    return files.mapInPandas(run, PAGES)


def cut_at(black: np.ndarray, nominal: int, mode: str = "reference") -> int:
    """Rows of the next stripe: nominal and up to a 16th more or less, where a row is white, or else has the least black.

    Looking down comes first. In reference mode the rows seen when looking up lie two higher than the cut.
    """
    reach = nominal >> 4
    best: tuple[int, int] | None = None
    for way in (range(reach + 1), range(-1, -reach - 1, -1)):
        for step in way:
            row = nominal + step - (2 if step < 0 and mode == "reference" else 0)
            if not 0 <= row < len(black):
                continue
            if best is None or black[row] < best[0]:
                best = (int(black[row]), step)
            if not black[row]:
                return nominal + step
        if best and not best[0]:
            break
    return nominal + (best[1] if best else 0)


def stripes_of(page: np.ndarray, splits: int, mode: str = "reference") -> list[tuple[int, int]]:
    """(top, height) of a page's stripes; the last takes what is left."""
    black, top, out = page.sum(axis=1), 0, []
    for k in range(splits):
        rest = page.shape[0] - top
        height = rest if k == splits - 1 else min(rest, cut_at(black[top:], page.shape[0] // splits, mode))
        out.append((top, height))
        top += height
    return out


def stripes(pages: DataFrame, splits: int = 1, mode: str = "reference") -> DataFrame:
    """Stripes of each of ``pages``, a byte a pixel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch.itertuples(index=False):
                page = pixels(p.raster, p.width, p.height)
                rows += [(p.doc_id, p.page_no, k, top, p.width, h, page[top : top + h].tobytes()) for k, (top, h) in enumerate(stripes_of(page, splits, mode))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STRIPES.split(", ")])

    return pages.mapInPandas(run, STRIPES)


def blank(px: Column) -> Column:
    """Whether a stripe (a byte a pixel) is white."""
    return F.ltrim(F.hex(px), F.lit("0")) == ""


def crop(bitmap: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """A rectangle, held to the image at its right and lower edge."""
    return bitmap[y : min(bitmap.shape[0], y + height), x : min(bitmap.shape[1], x + width)]


def with_margins(bitmap: np.ndarray, left: int, right: int, top: int, bottom: int) -> np.ndarray:
    """White margins where positive, a cut where negative."""
    cut = bitmap[max(0, -top) : bitmap.shape[0] - max(0, -bottom), max(0, -left) : bitmap.shape[1] - max(0, -right)]
    return np.pad(cut, ((max(0, top), max(0, bottom)), (max(0, left), max(0, right))))


def from_grey(data: bytes) -> np.ndarray:
    """A binary grey image as a bitmap: all that isn't 0 is black."""
    m = re.match(rb"P5\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+\d+\s", data)
    if not m:
        raise ValueError("not a binary grey image")
    width, height = int(m[1]), int(m[2])
    return (np.frombuffer(data[m.end() : m.end() + width * height], np.uint8).reshape(height, width) != 0).astype(np.uint8)
