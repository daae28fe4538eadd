"""Word shingles of a text as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit input (one to one)."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h = h ^ (h >> _U(27))
    h = h * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


class Shingler:
    """Hashes words by a polynomial over their bytes, all words of a text at once, and then windows of words."""

    def __init__(self, width: int = 5, seed: int = 20_240_101):
        rng = np.random.default_rng(seed)
        odd = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)
        self.width, self.byte, self.step, self.place = width, odd(256), odd(1)[0], odd(width + 1)
        self.inverse = _U(pow(int(self.step), -1, 2**64))
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 1 << 14)
            up = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64))])
            self.powers, self.inverses = up(self.step), up(self.inverse)

    def words(self, text: str | None, table: bytes = LOWER) -> np.ndarray:
        """A hash for each maximal run of characters other than U+0020 and U+0009 to U+000D, after `table` maps bytes."""
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(table), np.uint8)
        if not len(raw):
            return np.empty(0, np.uint64)
        self._grow(len(raw) + 1)
        edge = np.diff(np.concatenate([[True], self.space[raw], [True]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        upto = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.powers[: len(raw)], out=upto[1:])
        return mixed((upto[end] - upto[begin]) * self.inverses[begin] + (end - begin).astype(np.uint64))

    def windows(self, words: np.ndarray) -> np.ndarray:
        """The hash of each window of `width` words in order; of the whole sequence where there are fewer."""
        n = len(words)
        if n == 0:
            return words
        k = min(n, self.width)
        h = np.repeat(self.place[-1:] * _U(k), n - k + 1)
        for i in range(k):
            h += words[i : n - k + 1 + i] * self.place[i]
        return mixed(h)

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingles, ascending."""
        return np.unique(self.windows(self.words(text)))
