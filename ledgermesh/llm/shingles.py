"""Word shingle hashes of whole texts, vectorised over Arrow buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A shingle is five
consecutive words; a text of one to four words has one shingle, the whole
sequence. Separators are ASCII bytes, so working on UTF-8 bytes is exact.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240611)
_PLACE = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * U(2) + U(1)
_COUNT = _rng.integers(1, 1 << 63, WIDTH + 1, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        step = np.full(size, U(_BASE if kind == "up" else _INVERSE))
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 1 << 22:
            _powers[kind] = have
    return have


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and how many words each row has."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
    low = _LOWER[buf]
    word = ~_SEPARATOR[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum((low.astype(U) + U(1)) * _power("up", n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("down", n)[starts] + (ends - starts).astype(U))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every shingle in text order, and row bounds into them."""
    words, per_row = word_hashes(buf, offsets)
    n = len(words)
    first = np.concatenate([[0], np.cumsum(per_row)])
    count = np.where(per_row >= WIDTH, per_row - WIDTH + 1, np.minimum(per_row, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(bounds[-1], U)
    if n >= WIDTH:
        full = np.full(n - WIDTH + 1, _COUNT[WIDTH])
        for j in range(WIDTH):
            full += words[j:n - WIDTH + 1 + j] * _PLACE[j]
    long_rows = np.flatnonzero(per_row >= WIDTH)
    if len(long_rows):
        take = np.repeat(first[long_rows] - bounds[long_rows], count[long_rows])
        at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in long_rows]) if len(long_rows) < len(per_row) \
            else np.arange(bounds[-1])
        out[at] = full[at + take]
    for r in np.flatnonzero((per_row > 0) & (per_row < WIDTH)):
        k = int(per_row[r])
        w = words[first[r]:first[r] + k]
        out[bounds[r]:bounds[r] + 1] = _COUNT[k:k + 1] + (w * _PLACE[:k]).sum(dtype=U, keepdims=True)
    return mix(out), bounds
