"""Hashes of words and shingles for many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(texts: Sequence[str | None], room: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about room bytes with the place of the first; A-Z in lower case, null as empty."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = ("" if text is None else text).encode("utf-8", "replace").lower()
        held.append(raw)
        size += len(raw)
        if size >= room:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def words(raws: Sequence[bytes], gaps: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, place of each text's first word and of the end); gaps tells for each byte
    whether it is between words, as the space must be."""
    return words_and_lines(raws, gaps)[:2]


def words_and_lines(raws: Sequence[bytes], gaps: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words(), the place of the first word of each line that has words, and of each block of lines after a line without."""
    b = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    blank = gaps[b]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, starts, starts
    breaks = np.concatenate([[0], np.flatnonzero(b == 10), ends - 1])
    heads, times = np.unique(np.searchsorted(starts, breaks), return_counts=True)
    blocks = heads[(times > 1) | np.isin(heads, bounds[:-1])]
    number = np.cumsum(first) - 1
    place = np.arange(len(b)) - starts[np.maximum(number, 0)]
    place[blank] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    value = (b.astype(np.uint64) + np.uint64(1)) * powers[place]
    value[blank] = 0
    return mix(np.add.reduceat(value, starts)), bounds, heads[heads < len(starts)], blocks[blocks < len(starts)]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * _FACTORS[i]
    return mix(total)


def short(hashes: np.ndarray) -> np.ndarray:
    """One shingle for a text of fewer words than a shingle has; none without words."""
    n = len(hashes)
    return mix(np.array([(hashes * _FACTORS[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)) if n else hashes


def sets(raws: Sequence[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted set of shingles of each text."""
    hashes, bounds = words(raws)
    every = shingles(hashes, k)
    for a, e in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(every[a : e - k + 1]) if e - a >= k else short(hashes[a:e])
