"""Words of many texts at once: positions, hashes and window hashes as numpy arrays.

A word is a run of bytes other than the six ASCII white-space characters. A hash of a span is a
polynomial over table-mapped bytes modulo 2**64, so that every span costs two reads of a prefix sum.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True

U64 = np.uint64
#: Values of a span whose powers a worker keeps.
KEPT_POWERS = (1 << 20) + 1


def _mixed(x: np.ndarray, multiplier: int) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x = x * U64(multiplier)
    x = x ^ (x >> U64(29))
    x = x * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(32))


class Lane:
    """One family of span hashes; two lanes with different seeds make 128 bits."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.letters = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(rng.integers(0, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.multiplier = int(rng.integers(0, 1 << 62)) * 2 + 1
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse. Those for a usual slice are kept, longer ones are made anew."""
        if len(self.up) >= n:
            return self.up, self.down
        made = [np.cumprod(np.concatenate(([U64(1)], np.full(max(n, 1 << 16), x, U64))), dtype=U64) for x in (self.base, self.inverse)]
        if n <= KEPT_POWERS:
            self.up, self.down = made
        return made[0], made[1]

    def _spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self._powers(len(values) + 1)
        prefix = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], dtype=U64, out=prefix[1:])
        return _mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64), self.multiplier)

    def of_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._spans(self.letters[data], starts, ends)

    def of_words(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._spans(hashes, starts, ends)

    def __getstate__(self):
        return {**self.__dict__, "up": np.ones(1, U64), "down": np.ones(1, U64)}


FIRST, SECOND = Lane(11), Lane(23)


class Words:
    """The words of a batch: byte start and end, text number, and the range of words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
        inside = ~SPACE[data] if inside is None else inside
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[1:][offsets[1:] > 0] - 1
        last[edges] = inside[edges]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lane: Lane = FIRST) -> np.ndarray:
        return lane.of_bytes(self.data, self.starts, self.ends)

    def windows(self, k: int) -> np.ndarray:
        """First words of all windows of k words that stay within one text."""
        if len(self) < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[: len(self) - k + 1] == self.text[k - 1 :])

    def bytes_at(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges between offsets."""
    prefix = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, dtype=np.int64, out=prefix[1:])
    return prefix[offsets[1:]] - prefix[offsets[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A flag for each of n positions: does any of the ranges hold it?"""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0


class Lookup:
    """Places of 64-bit keys in a sorted table, behind a bit filter that turns most strangers away cheaply."""

    def __init__(self, keys: np.ndarray, bits: int = 21):
        self.keys, self.shift = keys, U64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(keys * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)] = True

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        out = np.full(len(asked), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(asked * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)])
        if len(maybe) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, asked[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == asked[maybe]
            out[maybe[hit]] = at[hit]
        return out
