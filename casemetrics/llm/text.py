"""Words and shingles of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
BYTE_VALUES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BYTE_VALUES_2 = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_2 = 0xC2B2AE3D27D4EB4F
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        both = []
        for value in (base, pow(base, -1, 2**64)):
            steps = np.full(size, value, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[base] = (both[0], both[1])
    up, down = _POWERS[base]
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES, base: int = BASE) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(base, len(data))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of the byte strings between starts and ends; equal strings get equal hashes."""
    down = powers(base, len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Starts, ends, hashes and text numbers of the words of texts that lie end to end in ``data``.

    Words are runs of bytes other than space and the bytes 9 to 13; offsets begin at 0.
    """
    space = IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    begins[inner] = ~space[inner]
    finishes = ~space
    finishes[:-1] &= space[1:]
    finishes[offsets[1:][np.diff(offsets) > 0] - 1] = ~space[offsets[1:][np.diff(offsets) > 0] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    sums = prefix_sums(LOWER[data] if lower else data)
    hashes = span_hashes(sums, starts, ends)
    return starts, ends, hashes, np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, size: int = 5):
    """Hashes of ``size`` words in a row and their text numbers; a shorter text is one shingle."""
    count = np.bincount(text, minlength=n_texts)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * weights[i]
    whole = text[:n] == text[size - 1 :] if n else np.zeros(0, bool)
    made, owner = [mix(total[whole])], [text[:n][whole]]
    first = np.concatenate([[0], np.cumsum(count)])
    for t in np.flatnonzero((count > 0) & (count < size)):
        own = hashes[first[t] : first[t + 1]]
        made.append(mix((own * weights[: len(own)]).sum(keepdims=True) + np.uint64(len(own))))
        owner.append(np.array([t]))
    made, owner = np.concatenate(made), np.concatenate(owner)
    order = np.lexsort((made, owner))
    made, owner = made[order], owner[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    return made[new], owner[new]
