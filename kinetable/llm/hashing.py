"""Words of many texts at once as arrays: bounds and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype="u8") * _ROOT)


def powers(root: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, root, "u8")
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = powers(_ROOT, 1 << 17), powers(_INVERSE, 1 << 17)
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts; with ``marks`` also cut between
    ASCII letters and marks other than the apostrophe.

    start, end: byte bounds in ``data``; doc: index of the text; hash: 64-bit hash of the bytes; first: for each text, the
    number of its first word (one entry more than texts).
    """

    def __init__(self, texts: list[bytes], lower: bool = False, marks: bool = False):
        data = np.frombuffer(b" ".join(texts) + b" ", "u1")
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = np.where(upper, data + np.uint8(32), data)
        self.data = data
        sizes = np.fromiter(map(len, texts), "i8", len(texts)) + 1
        ends = np.cumsum(sizes)
        space = SPACE[data]
        before = np.concatenate(([True], space[:-1]))
        starts, stops = ~space & before, space & ~before
        if marks:
            letter, mark = LETTER[data], MARK[data]
            turn = np.zeros(len(data), bool)
            turn[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
            starts |= turn
            stops |= turn
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(stops)
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        """Polynomial hash of each word from prefix sums, scaled back to position 0 and mixed with the length."""
        out = np.empty(len(self.start), "u8")
        step, at, up, down = 1 << 17, 0, _UP, _DOWN
        while at < len(self.start):  # slices keep the powers short and in cache
            lo = self.start[at]
            stop = max(at + 1, int(np.searchsorted(self.end, lo + step, "right")))
            part = _BYTE[self.data[lo : self.end[stop - 1]]]
            if len(part) > len(up):
                up, down = powers(_ROOT, len(part)), powers(_INVERSE, len(part))
            part *= up[: len(part)]
            total = np.zeros(len(part) + 1, "u8")
            np.cumsum(part, out=total[1:])
            a, b = self.start[at:stop] - lo, self.end[at:stop] - lo
            out[at:stop] = (total[b] - total[a]) * down[a]
            at = stop
        return mix(out ^ (self.end - self.start).astype("u8"))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (may cross texts; the caller masks those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, "u8")
    total = np.concatenate((np.zeros(1, "u8"), np.cumsum(words * powers(_ROOT, len(words)), dtype="u8")))
    return mix((total[k:] - total[:n]) * powers(_INVERSE, n))


def utf8(texts) -> list[bytes]:
    return [b"" if t is None or t != t else t.encode() for t in texts]
