"""Hashed word shingles of whole texts, vectorised."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Words are maximal runs of 0-9, a-z and any character from U+0080, after lower-casing.
SEPARATOR = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_IN = np.zeros(256, bool)
_IN[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IN[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place on a copy)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = _IN[raw]
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(raw), dtype=np.uint64)
    place[starts[0]:] -= np.repeat(place[starts], np.diff(np.append(starts, len(raw))))
    value = np.where(inside, mix((raw.astype(np.uint64) + np.uint64(1)) * _A + place * _B), np.uint64(0))
    return mix(np.add.reduceat(value, starts))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each run of ``words`` words; a shorter text that has words is one shingle."""
    w = word_hashes(text)
    n = max(1, len(w) - words + 1) if len(w) else 0
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(w))):
        out = mix(out + w[i:i + n] * _A + np.uint64(i))
    return out


def weighted(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and how often each occurs."""
    return np.unique(shingles(text, words), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two results of :func:`weighted`; 0 if either is empty."""
    at = np.searchsorted(a[0], b[0])
    hit = at < len(a[0])
    hit[hit] = a[0][at[hit]] == b[0][hit]
    common = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    union = a[1].sum() + b[1].sum() - common
    return float(common / union) if union and common else 0.0
