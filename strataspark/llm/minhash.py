"""Word shingles, MinHash signatures and exact Jaccard, in numpy."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

SHINGLE_WORDS = 5
#: Similarity 4/5 in whole numbers: 5 * shared >= 4 * union.
SIMILAR = (4, 5)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def normal(text: str | None) -> bytes:
    """The text's words (ASCII white space parts them), A-Z lower-cased, one space between."""
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def key_of(normalised: bytes) -> bytes:
    return hashlib.md5(normalised, usedforsecurity=False).digest()


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; kept and grown by doubling."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(normalised: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; shorter texts
    that have a word are one run, empty ones have none."""
    return np.unique(runs(normalised, words))


def runs(normalised: bytes, words: int) -> np.ndarray:
    """The same hashes, one for each run, in text order."""
    if not normalised:
        return np.empty(0, dtype=np.uint64)
    data, starts, ends = _bounds(normalised)
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return _run_hashes(data, starts, ends)


def runs_of(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """``runs`` of each text, one text after another, and how many each has: all are hashed at once."""
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], dtype=np.int64)
    n = np.where(counts > words, counts - words + 1, np.minimum(counts, 1))
    if not n.any():
        return np.empty(0, dtype=np.uint64), n
    data, starts, ends = _bounds(b" ".join([t for t in texts if t]))
    # the first and the last word of each run, which stays within its text
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = first + np.repeat(np.minimum(counts, words), n) - 1
    return _run_hashes(data, starts[first], ends[last]), n


def _bounds(normalised: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and where each word starts and ends."""
    data = np.frombuffer(normalised, dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)
    return data, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])


def _run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    # hash of a run: its part of the running polynomial sum, moved to power 0
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts]
    return _mixed(h + (ends - starts).astype(np.uint64))


@lru_cache(maxsize=4)
def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(hashes: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n minima of the hashes under n multiply-add functions (top 32 bits)."""
    a, b = _family(n, seed)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, (1 << 18) // n)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step, None] * a + b
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(hashes: np.ndarray, counts: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """``signature`` of each of the sets that stand one after another (``counts`` hashes each,
    one at least; repeated ones don't matter), one row for each."""
    a, b = _family(n, seed)
    out = np.empty((len(counts), n), dtype=np.uint32)
    starts = np.cumsum(counts) - counts
    own = np.empty_like(hashes)
    for j in range(n if len(counts) else 0):
        np.multiply(hashes, a[j], out=own)
        own += b[j]
        out[:, j] = np.minimum.reduceat(own, starts) >> np.uint64(32)
    return out


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of sets with exact Jaccard of at least SIMILAR, and their Jaccard; within
    ``left`` (i < j) if ``right`` is None. Shared counts are products of 0/1 matrices over
    the elements that at least two sets have, some thousand elements at a time."""
    sets = left if right is None else left + right
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    n, m = len(left), len(sets) - len(left)
    none = np.empty(0, dtype=np.int64)
    within = right is None
    if not sizes.sum() or not n or not (within or m):
        return none, none, np.empty(0)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    element = np.cumsum(new) - 1
    often = np.bincount(element)[element] > 1
    element, owner = element[often], owner[often]
    if not len(element):
        return none, none, np.empty(0)
    element = np.cumsum(np.concatenate([[True], element[1:] != element[:-1]])) - 1
    shared = np.zeros((n, n if within else m), dtype=np.float32)
    width = max(256, min(8192, (1 << 23) // max(1, len(sets))))
    for low in range(0, int(element[-1]) + 1, width):
        a, b = np.searchsorted(element, [low, low + width])
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[owner[a:b], element[a:b] - low] = 1.0
        shared += has[:n] @ (has if within else has[n:]).T
    up, down = SIMILAR
    other = sizes if within else sizes[n:]
    union = sizes[:n, None] + other[None, :] - shared
    alike = (down * shared >= up * union) & (shared > 0)
    if within:
        alike = np.triu(alike, 1)
    i, j = np.nonzero(alike)
    return i, j, shared[i, j] / union[i, j]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Which pairs make a spanning forest: at most n - 1 of them join what all join."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(k)
    return out
