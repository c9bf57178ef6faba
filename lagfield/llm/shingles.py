"""Word shingles of texts and their one-permutation sketches, in numpy."""

from __future__ import annotations

import numpy as np

BINS, WORDS = 512, 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(5).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For each bin the order in which it looks for a filled one: densification in which every bin draws its own.
_ORDER = np.stack([np.random.default_rng(1000 + i).permutation(BINS) for i in range(BINS)])
BLOCK = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece of bytes that ends between words."""
    low = _LOWER[raw]
    space = _SPACE[raw]
    head = ~space
    head[1:] &= space[:-1]
    starts = np.flatnonzero(head)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.zeros(len(raw), np.int32)
    at[starts[0] :] = np.arange(len(raw) - starts[0]) - np.repeat(starts - starts[0], np.diff(np.r_[starts, len(raw)]))
    powers = np.cumprod(np.full(int(at.max()) + 1, _BASE, np.uint64))
    values = (low.astype(np.uint64) + np.uint64(1)) * powers[at]
    values[space] = 0
    return _mix(np.add.reduceat(values, starts)), starts


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its words in order, A-Z in lower case. Works block by block, so that a long text needs little more than its hashes."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            raw = np.frombuffer(b" ".join(texts[i] for i in held), np.uint8)
            hashes, starts = _word_hashes(raw)
            ends = np.cumsum([len(texts[i]) + 1 for i in held])
            for i, part in zip(held, np.split(hashes, np.searchsorted(starts, ends[:-1])), strict=True):
                out[i] = part
        held, size = [], 0

    for i, t in enumerate(texts):
        if len(t) <= BLOCK:
            if size + len(t) > BLOCK:
                flush()
            held.append(i)
            size += len(t)
            continue
        raw, parts, at = np.frombuffer(t, np.uint8), [], 0
        while at < len(raw):
            end = min(at + BLOCK, len(raw))
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
            parts.append(_word_hashes(raw[at:end])[0])
            at = end
        out[i] = np.concatenate(parts)
    flush()
    return out


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of all five-word shingles; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return _mix((words * _STEPS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += words[k : n - WORDS + 1 + k] * _STEPS[k]
    return np.unique(_mix(total))


def sketch(found: np.ndarray) -> np.ndarray:
    """One byte for each bin: of its smallest hash; empty bins take over the first filled one in their own order."""
    bins = (found >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    codes, full = np.zeros(BINS, np.uint8), np.zeros(BINS, bool)
    codes[bins[first]] = (found[first] & np.uint64(255)).astype(np.uint8)
    full[bins[first]] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _ORDER[empty]
        codes[empty] = codes[order[np.arange(len(empty)), full[order].argmax(1)]]
    return codes
