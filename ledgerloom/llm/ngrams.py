"""Hashes of character n-grams over blocks of texts, in numpy."""

from __future__ import annotations

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> _S30)) * M1
    x = (x ^ (x >> _S27)) * M2
    return x ^ (x >> _S31)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts laid end to end, each after a space, and where each starts; one more start marks the end."""
    lowered = [" " + x.lower() for x in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lowered])])
    flat = np.frombuffer(("".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32)
    return flat, starts


_TABLE = np.zeros(0x110000, np.uint8)
_READY = False


def letter_table() -> np.ndarray:
    """1 for each code point that is a letter."""
    global _READY
    if not _READY:
        _TABLE[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
        _READY = True
    return _TABLE
