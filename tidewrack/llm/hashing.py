"""Words and word shingles of many texts as numpy hashes, a bounded chunk of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at once (one longer text is handled alone).
CHUNK = 1 << 20
_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_MIX = _SEED.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_BASE = int(_SEED.integers(1, 1 << 62)) * 2 + 1
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.ones(size, dtype=np.uint64), np.ones(size, dtype=np.uint64)
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        if i > start and n + len(t) > CHUNK:
            yield start, i
            start, n = i, 0
        n += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of all texts in turn, and where each text's words start (one more entry than texts)."""
    joined = b"\n".join(texts) + b"\n"
    b = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    gap = _GAP[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)))
    h = scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))))
    return h, np.searchsorted(starts, at)


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (63 bits, int64) of its k-word shingles; of fewer words, of the whole sequence; of none, nothing."""
    for lo, hi in chunks(texts):
        h, first = word_hashes(texts[lo:hi])
        n = max(0, len(h) - k + 1)
        s = np.full(n, np.uint64(k))
        for j in range(k):
            s += h[j : j + n] * _MIX[j]
        s = (scramble(s) >> np.uint64(1)).astype(np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                x = np.sort(s[a : b - k + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                few = np.uint64(b - a) + (h[a:b] * _MIX[: b - a]).sum(dtype=np.uint64)
                yield (scramble(np.array([few])) >> np.uint64(1)).astype(np.int64)
            else:
                yield np.zeros(0, np.int64)
