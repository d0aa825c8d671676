"""Vectorised hashing of words and word runs; numpy arrays of wrapping 64-bit integers throughout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
SLICE = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every word of the texts in order; words are runs of a-z and 0-9 of the lower-cased text."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends_of = np.cumsum([len(r) + 1 for r in raw])
    inside = np.concatenate(([False], _WORD[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_RANDOM[data] * _powers(_INVERSE, len(data)), dtype=np.uint64)))
    hashes = mix((total[ends] - total[starts]) * _powers(_BASE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(ends_of, starts, "right")


def runs(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every run of n consecutive words of one owner."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, owner.dtype)
    last = len(hashes) - n + 1
    out = np.zeros(last, np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : i + last] + np.uint64(i + 1))
    same = owner[:last] == owner[n - 1 :]
    return out[same], owner[:last][same]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters, so that memory doesn't grow with a batch of long texts."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
