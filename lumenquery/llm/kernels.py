"""Vectorised word hashing shared by the text operators.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which on UTF-8 is
the same as the code-point pattern ``[^\\x20\\x09-\\x0D]+``. Word hashes are 64-bit
polynomials over a random byte table, finalised by a bit mixer; windows of k
words are hashed in constant time from prefix sums.
"""

from __future__ import annotations

import numpy as np

SLICE_BYTES = 256 << 10
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xD6E8FEB86659FD93
_WINDOW_INVERSE = pow(_WINDOW_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    def __init__(self, base: int):
        self.base, self.table = base, _powers(base, 1 << 12)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = _powers(self.base, max(n, 2 * len(self.table)))
        return self.table


_POW, _WPOW, _WINV = _Powers(_BASE), _Powers(_WINDOW_BASE), _Powers(_WINDOW_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hash_slice(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one byte slice."""
    inside = np.empty(len(buf) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lens = ends - starts
    first = np.cumsum(lens) - lens
    within = np.arange(lens.sum()) - np.repeat(first, lens)
    values = table[buf[inside[1:-1]]]
    values *= _POW.upto(int(lens.max()))[within]
    return mix(np.add.reduceat(values, first) + lens.astype(np.uint64)), starts


def _cuts(text: bytes) -> list[bytes]:
    """Slices of at most SLICE_BYTES cut at white space, so memory doesn't grow with a text's bytes."""
    out, at = [], 0
    while len(text) - at > SLICE_BYTES:
        end = at + SLICE_BYTES
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


def word_hashes(texts: list[bytes | None], lower: bool = False) -> list[np.ndarray]:
    """One uint64 array of word hashes per text; None counts as empty. lower folds A-Z only."""
    table = _BYTE_LOWER if lower else _BYTE
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            parts = [texts[i] for i in group]
            begin = np.cumsum([0] + [len(p) + 1 for p in parts])
            h, starts = _hash_slice(np.frombuffer(b" ".join(parts), np.uint8), table)
            at = np.searchsorted(starts, begin)
            for k, i in enumerate(group):
                out[i] = h[at[k] : at[k + 1]]
        group, size = [], 0

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > SLICE_BYTES:
            out[i] = np.concatenate([_hash_slice(np.frombuffer(c, np.uint8), table)[0] for c in _cuts(t) if c])
            continue
        if size + len(t) > SLICE_BYTES:
            flush()
        group.append(i)
        size += len(t) + 1
    flush()
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (empty when there are fewer)."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * _WPOW.upto(n)[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * _WINV.upto(n)[: n - k + 1])


def span_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word span [start, end)."""
    n = len(words)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * _WPOW.upto(n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _WINV.upto(n + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words make one shingle, none make none."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < k:
        return span_hash(words, np.array([0]), np.array([len(words)]))
    return np.unique(window_hashes(words, k))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
