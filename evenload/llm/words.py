"""Words of texts as 64-bit hashes, vectorised over batches.

A word is a maximal run without white space (\\x20, \\x09-\\x0D) of the
lower-cased text. Its hash is a polynomial over its UTF-8 bytes modulo 2 ** 64,
mixed; equal words have equal hashes in every batch and process.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_APART = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_SYMBOL = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of them."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def hash_words(texts: Sequence[str | None], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and offsets: text i has words offsets[i] to offsets[i + 1].

    bare: every ASCII character that is no letter or digit also ends a word.
    """
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    space = (_APART if bare else _SPACE)[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_SYMBOL[buf] * up[: len(buf)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, bounds)


def batches(texts: Sequence[str | None], chars: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > chars:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; fewer than k words make one shingle, none make none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    return mix64(out)
