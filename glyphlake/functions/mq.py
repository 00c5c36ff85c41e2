"""The MQ binary arithmetic coder of ITU-T T.88 annex E, and its decoder.

Contexts are named by a family and a number; each starts in state 0 with 0 as the likelier bit.
"""

from __future__ import annotations

#: Fixed values of the recommendation's table: interval size, next state after the likelier and the less likely bit, switch.
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0),
    (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0),
    (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
END_MARKER = b"\xff\xac"


class Encoder:
    decoding = False

    def __init__(self) -> None:
        self.low, self.range, self.room = 0, 0x8000, 12
        self.out = bytearray(b"\0")  # a byte before the first, for its carry
        self.contexts: dict[tuple[str, int], list[int]] = {}

    def bit(self, family: str, number: int, value: int) -> int:
        cx = self.contexts.setdefault((family, number), [0, 0])
        size, likelier, unlikely, switch = STATES[cx[0]]
        self.range -= size
        if value == cx[1]:
            if self.range & 0x8000:
                self.low += size
                return value
            if self.range < size:
                self.range = size
            else:
                self.low += size
            cx[0] = likelier
        else:
            if self.range < size:
                self.low += size
            else:
                self.range = size
            if switch:
                cx[1] ^= 1
            cx[0] = unlikely
        while not self.range & 0x8000:
            self.range <<= 1
            self.low <<= 1
            self.room -= 1
            if not self.room:
                self._byte()
        return value

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.low >= 0x8000000:
            self.out[-1] += 1
            self.low &= 0x7FFFFFF
        if self.out[-1] == 0xFF:  # a bit is stuffed after it
            self.out.append(self.low >> 20)
            self.low &= 0xFFFFF
            self.room = 7
        else:
            self.out.append(self.low >> 19)
            self.low &= 0x7FFFF
            self.room = 8

    def coded_bits(self) -> int:
        return 8 * (len(self.out) - 1)

    def finish(self) -> bytes:
        top = self.low + self.range
        self.low |= 0xFFFF
        if self.low >= top:
            self.low -= 0x8000
        for _ in range(2):
            self.low <<= self.room
            self._byte()
        return bytes(self.out[1:]).rstrip(b"\xff") + END_MARKER


class Decoder:
    decoding = True

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.contexts: dict[tuple[str, int], list[int]] = {}
        self.code = self._peek(0) << 16
        self.room = 0
        self._byte()
        self.code <<= 7
        self.room -= 7
        self.range = 0x8000

    def _peek(self, k: int) -> int:
        return self.data[self.at + k] if self.at + k < len(self.data) else 0xFF

    def _byte(self) -> None:
        if self._peek(0) == 0xFF:
            if self._peek(1) > 0x8F:
                self.code += 0xFF00
                self.room = 8
            else:
                self.at += 1
                self.code += self._peek(0) << 9
                self.room = 7
        else:
            self.at += 1
            self.code += self._peek(0) << 8
            self.room = 8

    def bit(self, family: str, number: int, value: int | None = None) -> int:
        cx = self.contexts.setdefault((family, number), [0, 0])
        size, likelier, unlikely, switch = STATES[cx[0]]
        self.range -= size
        if (self.code >> 16) < size:  # the lower part
            out = cx[1] if self.range < size else 1 - cx[1]
            exchanged = self.range < size
            self.range = size
            if exchanged:
                cx[0] = likelier
            else:
                if switch:
                    cx[1] ^= 1
                cx[0] = unlikely
        else:
            self.code -= size << 16
            if self.range & 0x8000:
                return cx[1]
            if self.range < size:
                out = 1 - cx[1]
                if switch:
                    cx[1] ^= 1
                cx[0] = unlikely
            else:
                out = cx[1]
                cx[0] = likelier
        while not self.range & 0x8000:
            if not self.room:
                self._byte()
            self.range <<= 1
            self.code = (self.code << 1) & 0xFFFFFFFF
            self.room -= 1
        return out
