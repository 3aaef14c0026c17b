"""Vectorised hashing of the words and word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x2545F4914F6CDD1D
_tables: dict[str, np.ndarray] = {}


def _grow(n: int) -> None:
    if len(_tables.get("up", ())) < n:
        size = 1 << n.bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _tables[name] = np.cumprod(powers)
        _tables["bytes"] = np.random.default_rng(17).integers(1, 1 << 63, 256).astype(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes data[start : start + length]: a polynomial of random values of the bytes."""
    n = len(data) + 1
    _grow(n)
    sums = np.zeros(n, np.uint64)
    np.cumsum(_tables["bytes"][data] * _tables["up"][: n - 1], out=sums[1:])
    return mix((sums[starts + lengths] - sums[starts]) * _tables["down"][starts] + lengths.astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of anything but ASCII white space."""
    solid = np.ones(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.nonzero(solid[1:] != solid[:-1])[0]
    return edge[::2], edge[1::2] - edge[::2]


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, lengths = words(data)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return run_hashes(data, starts, lengths), np.diff(np.searchsorted(starts, ends), prepend=0)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of `width` words, number of shingles of each text); a shorter text of any words is one shingle."""
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    if not len(hashes):
        return hashes, many
    n = len(hashes)
    padded = np.concatenate([hashes, np.zeros(width - 1, np.uint64)])
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words of the text from here on
    total = np.repeat(counts, counts)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & 0xFFFFFFFFFFFFFFFF)
        out += np.where(left > k, mix(padded[k : k + n] + odd), np.uint64(0)) * np.uint64(2 * k + 1)
    keep = (left >= width) | ((total < width) & (left == total))
    return mix(out[keep]), many
