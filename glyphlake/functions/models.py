"""What is coded bit by bit, and under which contexts. Each function codes with an Encoder and decodes with a Decoder."""

from __future__ import annotations

import numpy as np

from .codes import INTEGER_RANGES, OUT_OF_BAND, OUT_OF_BAND_BITS, code_of
from .mq import Decoder, Encoder

Coder = Encoder | Decoder

_PREFIXES = {(prefix, bits): (first, last, more) for first, last, prefix, bits, more in INTEGER_RANGES}
#: Pixels of the context of a direct bitmap, from the highest bit: two rows up, one row up, the same row.
DIRECT = ((-2, -1), (-2, 0), (-2, 1), (-1, -2), (-1, -1), (-1, 0), (-1, 1), (-1, 2), (0, -2), (0, -1))
#: Of a refined bitmap: pixels of the reference, then its own.
REFERENCE = ((-1, 0), (0, -1), (0, 0), (0, 1), (1, 0), (1, 1))
OWN = ((-1, -1), (-1, 0), (-1, 1), (0, -1))


def integer(coder: Coder, family: str, value: int | None = None) -> int | None:
    """An integer, or None for out of band, under the last eight bits of its own code."""
    context = 1

    def step(bit: int | None) -> int:
        nonlocal context
        got = coder.bit(family, context, bit)
        context = (context << 1) | got if context < 256 else (((context << 1) | got) & 511) | 256
        return got

    if not coder.decoding:
        word, length = code_of(value)
        for k in reversed(range(length)):
            step((word >> k) & 1)
        return value
    word = length = 0
    while True:
        word, length = (word << 1) | step(None), length + 1
        if (word, length) == (OUT_OF_BAND, OUT_OF_BAND_BITS):
            return None
        if (word, length) in _PREFIXES:
            first, last, more = _PREFIXES[word, length]
            offset = 0
            for _ in range(more):
                offset = (offset << 1) | step(None)
            return last - offset if last < 0 else first + offset


def symbol_id(coder: Coder, length: int, value: int = 0) -> int:
    context = 1
    for k in reversed(range(length)):
        context = (context << 1) | coder.bit("id", context, (value >> k) & 1)
    return context - (1 << length)


def _shifted(page: np.ndarray, spots: tuple, pad: int = 2) -> np.ndarray:
    """For each pixel, the pixels at ``spots`` as one number."""
    h, w = page.shape
    padded = np.pad(page.astype(np.int32), pad)
    out = np.zeros((h, w), np.int32)
    for dy, dx in spots:
        out = (out << 1) | padded[pad + dy : pad + dy + h, pad + dx : pad + dx + w]
    return out


def direct(coder: Coder, height: int, width: int, bitmap: np.ndarray | None = None, family: str = "direct") -> np.ndarray:
    if not coder.decoding:
        for number, value in zip(_shifted(bitmap, DIRECT).ravel().tolist(), bitmap.ravel().tolist()):
            coder.bit(family, number, value)
        return bitmap
    out = np.zeros((height + 2, width + 4), np.uint8)
    for y in range(height):
        for x in range(width):
            number = 0
            for dy, dx in DIRECT:
                number = (number << 1) | int(out[y + 2 + dy, x + 2 + dx])
            out[y + 2, x + 2] = coder.bit(family, number)
    return out[2:, 2 : width + 2]


def on_reference(ref: np.ndarray, height: int, width: int, dx: int, dy: int) -> np.ndarray:
    """The reference moved by (dx, dy) on a canvas of the bitmap's size with a border of one."""
    out = np.zeros((height + 2, width + 2), np.uint8)
    top, left = 1 + dy, 1 + dx
    a, b = max(0, top), max(0, left)
    part = ref[a - top : height + 2 - top, b - left : width + 2 - left]
    out[a : a + part.shape[0], b : b + part.shape[1]] = part
    return out


def refined(coder: Coder, ref: np.ndarray, height: int, width: int, dx: int = 0, dy: int = 0, bitmap: np.ndarray | None = None) -> np.ndarray:
    under = on_reference(ref, height, width, dx, dy)
    base = np.zeros((height, width), np.int32)
    for oy, ox in REFERENCE:
        base = (base << 1) | under[1 + oy : 1 + oy + height, 1 + ox : 1 + ox + width]
    if not coder.decoding:
        for number, value in zip(((base << 4) | _shifted(bitmap, OWN, 1)).ravel().tolist(), bitmap.ravel().tolist()):
            coder.bit("refine", number, value)
        return bitmap
    out = np.zeros((height + 1, width + 2), np.uint8)
    for y in range(height):
        for x in range(width):
            number = int(base[y, x])
            for oy, ox in OWN:
                number = (number << 1) | int(out[y + 1 + oy, x + 1 + ox])
            out[y + 1, x + 1] = coder.bit("refine", number)
    return out[1:, 1 : width + 1]
