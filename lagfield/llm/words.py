"""Words of whole texts as small numbers, and windows of words that a text has twice; in numpy, for Arrow batches."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def numbered(words: list[bytes] | list[str], known: dict) -> np.ndarray:
    """Numbers of words: equal words, equal numbers. New words go on from ``len(known)``, which stays with the caller."""
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every window of k numbers. Equal windows have equal hashes; the reverse is for the caller to see to."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = (total ^ mixed[j : j + n]) * np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
    return total


def maybe_repeated(ids: np.ndarray, k: int) -> np.ndarray:
    """Windows that may occur twice, in order of their start: all that do, and those whose hash another one has."""
    hashes = window_hashes(ids, k)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.flatnonzero(twice)


def repeated(ids: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k numbers that occur twice or more: hashes choose them, the numbers themselves decide."""
    some = maybe_repeated(ids, k)
    if not len(some):
        return some
    rows = np.ascontiguousarray(ids[some[:, None] + np.arange(k)])
    _, kind, count = np.unique(rows.view([("", rows.dtype)] * k).ravel(), return_inverse=True, return_counts=True)
    return some[count[kind.ravel()] > 1]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of length k that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + k, -1)
    return np.cumsum(step[:n]) > 0
