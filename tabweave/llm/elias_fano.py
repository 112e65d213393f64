"""Elias-Fano coding of ascending integers, with select."""

from __future__ import annotations

import numpy as np

#: Every so many ones of the upper half have their place sampled.
SAMPLE = 512
#: So many values are spread into bits at a time, eight or a multiple of it.
SPREAD = 1 << 14
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """n ascending integers from 0 to `top` in about 2 + log2(top / n) bits each.

    Each value's lower `low_bits` bits stand packed; the upper parts stand in unary,
    as one bit vector with n ones. Samples of the ones' places need 32 bits each.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        top = int(values[-1])
        low_bits = max(0, ((top + 1) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        # a multiple of eight values at a time makes whole bytes
        low = np.concatenate([np.packbits(((values[at : at + SPREAD, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for at in range(0, n, SPREAD)])
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def sections(self) -> tuple[bytes, bytes, bytes]:
        return self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        first, last = at // 8, (at + self.low_bits + 7) // 8
        return int.from_bytes(self.low[first:last].tobytes(), "little") >> at % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample onwards."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        seen = int(_POPCOUNT[self.high[byte] >> place % 8]) if left else 1
        if seen > left:
            word, start = int(self.high[byte]) >> place % 8, place
        else:
            while seen <= left:
                left -= seen
                byte += 1
                seen = int(_POPCOUNT[self.high[byte]])
            word, start = int(self.high[byte]), 8 * byte
        for _ in range(left):
            word &= word - 1
        place = start + (word & -word).bit_length() - 1
        return place - i << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values."""
        if not self.n:
            return np.zeros(0, np.uint64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        upper = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return upper | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
