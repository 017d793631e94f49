"""Five-word shingle sets of whole texts as 64-bit hashes, in numpy.

Works on UTF-8 bytes: A-Z lower-cased, words split at spaces and U+0009 to
U+000D. A text's set holds its distinct five-word shingles; with fewer words the
whole sequence is its one shingle; without words it is empty.
"""

from __future__ import annotations

import numpy as np

from .ngrams import mix64

SHINGLE = 5
_G = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix64((np.arange(256, dtype=np.uint64) + np.uint64(11)) * _G)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_AS_IS = np.arange(256, dtype=np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1, np.uint64)
_NONE = np.zeros(0, np.uint64)
_P = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1024), _P)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased or as it is, and the number of words of each text."""
    raw = [x.encode("utf-8", "replace") for x in texts]
    flat = (_LOWER if lower else _AS_IS)[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    starts = np.cumsum([0] + [len(x) + 1 for x in raw])
    inside = ~_SPACE[flat]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts = np.diff(np.searchsorted(first, starts))
    if not len(first):
        return np.zeros(0, np.uint64), counts
    length = last - first
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    value = _BYTES[flat[inside]] * _powers(int(length.max()))[place]
    return mix64(np.add.reduceat(value, begin) + length.astype(np.uint64) * _G), counts


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): text i's set is hashes[ends[i]:ends[i + 1]], sorted."""
    words, counts = word_hashes(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    parts, owners, short = [], [], {}
    long = counts >= SHINGLE
    if len(words) >= SHINGLE and long.any():
        m = len(words) - SHINGLE + 1
        h = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            h = mix64(h * _G + words[k : k + m])
        owner = np.repeat(np.arange(len(texts)), counts)
        ok = owner[:m] == owner[SHINGLE - 1 :]
        parts.append(h[ok])
        owners.append(owner[:m][ok])
    for i in np.flatnonzero(~long & (counts > 0)):
        h = np.full(1, counts[i], np.uint64)  # the length keeps short sequences apart
        for w in words[ends[i] : ends[i + 1]]:
            h = mix64(h * _G + w)
        short[i] = h ^ _G
    found: list[np.ndarray] = [_NONE] * len(texts)
    if long.any() and len(words) >= SHINGLE:
        cuts = np.searchsorted(owners[0], np.arange(len(texts) + 1))
        for i in np.flatnonzero(long):
            found[i] = np.unique(parts[0][cuts[i] : cuts[i + 1]])
    for i, h in short.items():
        found[i] = h
    return np.concatenate([_NONE, *found]), np.cumsum([0] + [len(x) for x in found])
