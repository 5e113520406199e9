"""Word-shingle sets as sorted 64-bit hashes, computed with numpy on whole texts."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1


def _splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return _splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Shingler:
    """Distinct shingles of `width` words. A shingle is a range of the single-spaced text,
    so its hash is a difference of prefix sums of a polynomial in an odd multiplier, over
    random values of the bytes, and then mixed."""

    def __init__(self, width: int = 5, seed: int = 11):
        self.width = width
        self.table = stream(256, seed)
        self.mult = int(stream(1, seed + 1)[0]) | 1
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                for name, m in (("up", self.mult), ("down", pow(self.mult, -1, 1 << 64))):
                    out = np.ones(1, np.uint64)
                    while len(out) < n:
                        out = np.concatenate([out, out * np.uint64(pow(m, len(out), 1 << 64))])
                    setattr(self, name, out)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; of all the words if there are fewer than width, none without words.
        A-Z count as a-z; words are split at space and U+0009 to U+000D."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        flat = b" ".join(words)
        data = np.frombuffer(flat, np.uint8)
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
            gaps = np.flatnonzero(data == 32)
            starts = np.concatenate([[0], gaps + 1])
            ends = np.concatenate([gaps, [len(data)]])
            k = min(self.width, len(starts)) - 1
            starts, ends = starts[: len(starts) - k], ends[k:]
            return np.unique(_splitmix((sums[ends] - sums[starts]) * self.down[starts]))


class OnePermutation:
    """One-permutation MinHash with optimal densification: the hash range is cut into bins,
    a bin's value is its least hash, and an empty bin copies the first filled one of its own
    random sequence of bins. bands * rows bins make `bands` bucket keys. The sequences are long enough for
    sets that fill a sixth of the bins (a chance of 1e-17 to miss all of those); smaller sets have `prefix`."""

    def __init__(self, bands: int = 40, rows: int = 5, seed: int = 29, probes: int = 256):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.edges = np.array([(i << 64) // self.bins for i in range(self.bins)], np.uint64)
        self.probe = (stream(self.bins * probes, seed) % np.uint64(self.bins)).astype(np.int64).reshape(probes, self.bins)
        self.salt = stream(bands, seed + 1)
        self.weights = stream(rows, seed + 2) | np.uint64(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: sorted, distinct, not empty."""
        at = np.searchsorted(hashes, self.edges)
        full = at < np.append(at[1:], len(hashes))
        values = hashes[np.minimum(at, len(hashes) - 1)]
        take = np.where(full, np.arange(self.bins), -1)
        for probe in self.probe:
            empty = np.flatnonzero(take < 0)
            if not len(empty):
                break
            to = probe[empty]
            take[empty] = np.where(full[to], to, -1)
        if (empty := np.flatnonzero(take < 0)).size:  # few hashes: the next filled bin from the last one tried
            filled = np.flatnonzero(full)
            take[empty] = filled[np.searchsorted(filled, self.probe[-1][empty]) % len(filled)]
        return values[take]

    def keys(self, signature: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _splitmix((_splitmix(signature.reshape(self.bands, self.rows)) * self.weights).sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64)


def prefix(hashes: np.ndarray, percent: int = 75) -> np.ndarray:
    """Keys of a small set: two sets that resemble one another share one of them, without exception. Both share
    at least percent of the larger set, so of either set's hashes, in order, the first |set| - that + 1
    have a common one."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        return _splitmix(hashes[: n + percent * -n // 100 + 1] ^ np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def resemble(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
