"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .word_tokens import span_hashes

WIDTH = 5
AT_ONCE = 1 << 18  # bytes of words that are hashed together: that takes some 50 bytes for each
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
# Odd factors, one for each place in a shingle.
_factors = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) for k in range(WIDTH)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word data[start:end]."""
    out, a = np.empty(len(start), dtype=np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + AT_ONCE, "right")))
        out[a:b] = span_hashes(_lower[data[start[a] : end[b - 1]]], start[a:b] - start[a], end[a:b] - start[a])
        a = b
    return mix(out)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted; the whole text as one if it has fewer words; none without words."""
    if not texts:
        return []
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    first = np.cumsum(sizes + 1) - sizes - 1
    inside = np.zeros(len(joined) + 2, dtype=np.int8)
    inside[1:-1] = ~_space[joined]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(start):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    word = _words(joined, start, end)
    words = np.bincount(np.searchsorted(first, start, "right") - 1, minlength=len(texts))
    at = np.cumsum(words) - words
    rolled = np.zeros(max(0, len(word) - WIDTH + 1), dtype=np.uint64)
    for k in range(WIDTH):
        rolled += word[k : k + len(rolled)] * _factors[k]
    rolled = mix(rolled)
    out = []
    for a, n in zip(at.tolist(), words.tolist()):
        if n >= WIDTH:
            out.append(np.unique(rolled[a : a + n - WIDTH + 1]))
        elif n:
            out.append(mix(np.array([(word[a : a + n] * _factors[:n]).sum() + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    at = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    return int(mix(np.array([mix(shingles + at * _factors[0]).sum() + np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])
