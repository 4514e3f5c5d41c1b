"""Elias-Fano sequences over numpy words: monotone numbers with access and search for many places at once."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 18
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the k-th set (flip: unset) bit; `before` counts those ahead of each word."""
    w = np.searchsorted(before, k, side="right") - 1
    word = words[w] ^ ALL if flip else words[w]
    left = (k - before[w]).astype(np.uint8)
    at = w << 6
    for half in (32, 16, 8, 4, 2, 1):  # the half of the bits that holds it
        low = np.bitwise_count(word & np.uint64((1 << half) - 1))
        up = left >= low
        left -= np.where(up, low, 0).astype(np.uint8)
        at += np.where(up, half, 0)
        word = np.where(up, word >> np.uint64(half), word)
    return at


def _run_from(words: np.ndarray, at: np.ndarray, ones: bool) -> np.ndarray:
    """Length of the run of set (or unset) bits that starts at each place; 64 stands for 64 or more."""
    w, s = at >> 6, (at & 63).astype(np.uint64)
    up = np.where(s > 0, words[np.minimum(w + 1, len(words) - 1)] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
    end = ((words[w] >> s) | up) ^ (ALL if ones else np.uint64(0))
    return np.where(end > 0, np.bitwise_count((end & (~end + ONE)) - ONE), 64).astype(np.int64)


class EliasFano:
    """A monotone sequence; its arrays may be memory-mapped."""

    FIELDS = ("high", "low", "ones", "zeros", "shape")

    def __init__(self, high: np.ndarray, low: np.ndarray, ones: np.ndarray, zeros: np.ndarray, shape: np.ndarray):
        self.high, self.low, self.ones, self.zeros, self.shape = high, low, ones, zeros, shape
        self.n, self.bits = int(shape[0]), int(shape[1])
        self.mask = np.uint64((1 << self.bits) - 1)

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """From sorted numbers under `universe`."""
        n = len(values)
        values = values.astype(np.uint64)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        top = (max(universe, 1) >> bits) + 1
        high = np.zeros((n + top) // 64 + 2, dtype=np.uint64)
        low = [np.zeros(0, dtype=np.uint8)]
        for at in range(0, n, CHUNK):
            part = values[at : at + CHUNK]
            place = (part >> np.uint64(bits)) + np.arange(at, at + len(part), dtype=np.uint64)
            word = (place >> np.uint64(6)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            high[word[cut]] |= np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), cut)
            if bits:
                rows = np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8)
                low.append(np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little"))
        packed = np.concatenate(low)
        packed = np.concatenate([packed, np.zeros(16 + -len(packed) % 8, dtype=np.uint8)]).view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.r_[0, np.cumsum(count)[:-1]]
        return cls(high, packed, ones, np.arange(len(high)) * 64 - ones, np.array([n, bits], dtype=np.int64))

    def arrays(self) -> dict[str, np.ndarray]:
        return {f: getattr(self, f) for f in self.FIELDS}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.bits
        w, s = at >> 6, (at & 63).astype(np.uint64)
        up = np.where(s > 0, self.low[w + 1] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
        return ((self.low[w] >> s) | up) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        i = i.astype(np.int64)
        high = _select(self.high, self.ones, i, False) - i
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at places i and i + 1."""
        i = i.astype(np.int64)
        bit = _select(self.high, self.ones, i, False)
        skip = _run_from(self.high, bit + 1, False)
        after = bit + 1 + skip
        far = np.flatnonzero(skip == 64)
        if len(far):
            after[far] = _select(self.high, self.ones, i[far] + 1, False)
        first, second = (((p - j).astype(np.uint64) << np.uint64(self.bits)) | self._low(j) for p, j in ((bit, i), (after, i + 1)))
        return first, second

    def successor(self, x: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first number >= x within its high part's run, whether it equals x); a, b bound the run further."""
        x = x.astype(np.uint64)
        if not len(x) or not self.n:
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        bit = np.where(h > 0, _select(self.high, self.zeros, np.maximum(h - 1, 0), True) + 1, 0)  # where the run of h begins
        start = bit - h
        run = _run_from(self.high, bit, True)
        until = start + run
        long = np.flatnonzero(run == 64)
        if len(long):
            until[long] = _select(self.high, self.zeros, h[long], True) - h[long]
        if a is not None:
            start, until = np.maximum(start, a), np.minimum(until, b)
        want = x & self.mask
        lo, hi = start.copy(), np.maximum(until, start)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        at = np.minimum(lo, self.n - 1)
        return lo, (lo < until) & (self._low(at) == want)
