"""Reads a file of segments back into pages."""

from __future__ import annotations

import numpy as np

from glyphlake.functions import models
from glyphlake.functions.mq import Decoder
from glyphlake.operators.extract import paint
from glyphlake.sources import container
from glyphlake.sources.container import Kind

from .encode import bits_for

HEAD = 17


def number(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "big")


def symbols(data: bytes, known: list[np.ndarray]) -> list[np.ndarray]:
    """Exported bitmaps of a dictionary segment."""
    refines, exported, new = bool(data[1] & 2), number(data, 4, 4), number(data, 8, 4)
    coder = Decoder(data[12:])
    total = len(known) + new
    out: list[np.ndarray] = []
    height = 0
    while len(out) < new:
        height += models.integer(coder, "dh")
        width = 0
        while (step := models.integer(coder, "dw")) is not None:
            width += step
            if refines:
                models.integer(coder, "ai")
                ref = [*known, *out][models.symbol_id(coder, bits_for(total))]
                dx, dy = models.integer(coder, "rdx"), models.integer(coder, "rdy")
                out.append(models.refined(coder, ref, height, width, dx, dy))
            else:
                out.append(models.direct(coder, height, width))
    every, flags, value = [*known, *out], [], False
    while len(flags) < len(every):
        flags += [value] * models.integer(coder, "ex")
        value = not value
    kept = [b for b, f in zip(every, flags) if f]
    if len(kept) != exported:
        raise ValueError("a dictionary exports another number than it says")
    return kept


def text(data: bytes, entries: list[np.ndarray], canvas: np.ndarray) -> None:
    flags, count = number(data, HEAD, 2), number(data, HEAD + 2, 4)
    refines, shift, gap = bool(flags & 2), flags >> 2 & 3, flags >> 10 & 31
    gap -= 32 if gap > 15 else 0
    coder = Decoder(data[HEAD + 6 :])
    models.integer(coder, "dt")
    top = first = 0
    while count:
        top += models.integer(coder, "dt") << shift
        first += models.integer(coder, "fs")
        x = first
        while True:
            bottom = top + (models.integer(coder, "it") if shift else 0)
            bitmap = entries[models.symbol_id(coder, bits_for(len(entries)))]
            if refines and models.integer(coder, "ri"):
                dw, dh = models.integer(coder, "rdw"), models.integer(coder, "rdh")
                dx, dy = models.integer(coder, "rdx"), models.integer(coder, "rdy")
                bitmap = models.refined(coder, bitmap, bitmap.shape[0] + dh, bitmap.shape[1] + dw, dx, dy)
            paint(canvas, bitmap, x, bottom - bitmap.shape[0] + 1)
            count -= 1
            step = models.integer(coder, "ds")
            if step is None:
                break
            x += bitmap.shape[1] - 1 + gap + step


def decode(content: bytes) -> list[np.ndarray]:
    """The pages of a file."""
    pages: list[np.ndarray] = []
    known: dict[int, list[np.ndarray]] = {}
    for n, s in container.parse(content):
        if s.kind is Kind.PAGE:
            pages.append(np.zeros((number(s.data, 4, 4), number(s.data, 0, 4)), np.uint8))
        elif s.kind is Kind.SYMBOLS:
            known[n] = symbols(s.data, [b for r in s.refers for b in known[r]])
        elif s.kind in (Kind.TEXT, Kind.GENERIC, Kind.REFINEMENT):
            width, height, y = number(s.data, 0, 4), number(s.data, 4, 4), number(s.data, 12, 4)
            part = pages[-1][y : y + height]
            if s.kind is Kind.TEXT:
                text(s.data, [b for r in s.refers for b in known[r]], part)
            elif s.kind is Kind.GENERIC:
                part |= models.direct(Decoder(s.data[HEAD + 3 :]), height, width)
            else:
                part[:] = models.refined(Decoder(s.data[HEAD + 1 :]), part.copy(), height, width)
    return pages
