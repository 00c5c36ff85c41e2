"""Segments and the file they make up."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

#: Fixed value: what a file begins with.
FILE_ID = bytes((0x97, 0x4A, 0x42, 0x32, 0x0D, 0x0A, 0x1A, 0x0A))


class Kind(IntEnum):
    SYMBOLS = 0
    TEXT = 6
    GENERIC = 38
    REFINEMENT = 42
    PAGE = 48
    END_OF_PAGE = 49
    END_OF_STRIPE = 50
    END_OF_FILE = 51


def big(value: int, size: int) -> bytes:
    return (value & ((1 << 8 * size) - 1)).to_bytes(size, "big")


@dataclass
class Segment:
    kind: Kind
    page: int
    data: bytes = b""
    refers: tuple[int, ...] = ()
    retain: bool = False
    retain_refs: tuple[bool, ...] = field(default_factory=tuple)

    def header(self, number: int) -> bytes:
        if len(self.refers) > 4:
            raise ValueError("a segment refers to four others at most")
        size = 1 if number <= 256 else 2 if number <= 65536 else 4
        flags = len(self.refers) << 5 | int(self.retain)
        for k, kept in enumerate(self.retain_refs):
            flags |= int(kept) << (k + 1)
        return big(number, 4) + big(self.kind & 63, 1) + big(flags, 1) + b"".join(big(r, size) for r in self.refers) + big(self.page, 1) + big(len(self.data), 4)


def file_header(pages: int) -> bytes:
    return FILE_ID + b"\x01" + big(pages, 4)


def parse(data: bytes) -> list[tuple[int, Segment]]:
    """Numbered segments of a file."""
    if data[:8] != FILE_ID:
        raise ValueError("not a file of segments")
    at, out = 13, []
    while at < len(data):
        number, kind, flags = int.from_bytes(data[at : at + 4], "big"), data[at + 4] & 63, data[at + 5]
        at += 6
        n, size = flags >> 5, 1 if number <= 256 else 2 if number <= 65536 else 4
        refers = tuple(int.from_bytes(data[at + k * size : at + (k + 1) * size], "big") for k in range(n))
        at += n * size
        page, length = data[at], int.from_bytes(data[at + 1 : at + 5], "big")
        at += 5
        out.append((number, Segment(Kind(kind), page, data[at : at + length], refers, bool(flags & 1), tuple(bool(flags >> (k + 1) & 1) for k in range(n)))))
        at += length
    return out


def region(width: int, height: int, y: int) -> bytes:
    return big(width, 4) + big(height, 4) + big(0, 4) + big(y, 4) + b"\0"


def page_info(width: int, height: int, lossless: bool, splits: int) -> bytes:
    stripes = 0x8000 | (height // splits + (height >> 3)) if splits > 1 else 0
    return big(width, 4) + big(height, 4) + big(0, 8) + big(int(lossless), 1) + big(stripes, 2)


def symbols_head(refines: bool, exported: int, new: int) -> bytes:
    return big(int(refines) << 12 | 2 << 10 | int(refines) << 1, 2) + big(2, 1) + big(-1, 1) + big(exported, 4) + big(new, 4)


def text_head(width: int, height: int, y: int, refines: bool, strip_bits: int, gap: int, count: int) -> bytes:
    flags = 1 << 15 | (gap & 31) << 10 | strip_bits << 2 | int(refines) << 1
    return region(width, height, y) + big(flags, 2) + big(count, 4)


def generic_head(width: int, height: int, y: int) -> bytes:
    return region(width, height, y) + big(2 << 1, 1) + big(2, 1) + big(-1, 1)


def refinement_head(width: int, height: int, y: int) -> bytes:
    return region(width, height, y) + b"\x01"
