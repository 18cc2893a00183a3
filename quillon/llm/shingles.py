"""Hashes of words and of word shingles for whole batches of texts, in numpy.

Words are runs of bytes other than space and tab to carriage return, with A-Z
lower-cased. Hashes have 64 bits: a polynomial of a word's bytes, and a sum of
word hashes times fixed odd numbers for a shingle, each mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP_BYTES = 1 << 19
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_COEFFICIENTS = np.random.default_rng(20).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit generator: every bit of the input reaches every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; only those of a usual run are remembered."""
    return _usual() if n <= 2 * STEP_BYTES else _made(n)


@lru_cache(1)
def _usual() -> tuple[np.ndarray, np.ndarray]:
    return _made(2 * STEP_BYTES)


def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(BASE), -1, 1 << 64)
    out = []
    for base in (BASE, np.uint64(inverse)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _some(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """All word hashes, words in each text, the bytes, and where each word begins and ends in them."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    space = _SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * power[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * _COEFFICIENTS[-1])
    bounds = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    return hashes, np.diff(np.append(bounds, len(starts))), data, starts, ends


def word_hashes(raw: list[bytes], step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts as (index of the first, all word hashes end to end, words in each text)."""
    for at, hashes, counts, *_ in word_runs(raw, step):
        yield at, hashes, counts


def word_runs(raw: list[bytes], step: int = STEP_BYTES) -> Iterator[tuple]:
    """As ``word_hashes``, with the run's bytes and where each word begins and ends in them.

    A run holds about ``step`` bytes, or one text; a longer text is hashed in
    pieces that end where a word does.
    """
    at = size = 0
    for i, x in enumerate(raw):
        if len(x) > step:
            if at < i:
                yield at, *_some(raw[at:i])
            parts = [_some([piece]) for piece in _pieces(x, step)]
            before = np.cumsum([0] + [len(p[2]) for p in parts[:-1]])
            places = (np.concatenate([p[k] + n for p, n in zip(parts, before, strict=True)]) for k in (3, 4))
            yield i, np.concatenate([p[0] for p in parts]), np.array([sum(int(p[1][0]) for p in parts)]), np.concatenate([p[2] for p in parts]), *places
            at, size = i + 1, 0
            continue
        if size and size + len(x) > step:
            yield at, *_some(raw[at:i])
            at, size = i, 0
        size += len(x) + 1
    if at < len(raw):
        yield at, *_some(raw[at:])


def _pieces(x: bytes, step: int) -> Iterator[bytes]:
    """A text in pieces of at least ``step`` bytes, each but the last up to the next space."""
    at = 0
    while at < len(x):
        end = at + step
        while end < len(x) and not _SPACE[x[end]]:
            end += 1
        yield x[at:end]
        at = end


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return (_LOWER[data] - np.uint64(1)).astype(np.uint8)


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, end to end with repeats, and how many each has.

    A text with fewer than ``size`` words has the whole sequence as its only one,
    a text without words none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = max(0, len(hashes) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(size):
        rolled += hashes[i : i + n] * _COEFFICIENTS[i]
    long = counts >= size
    made = np.where(long, counts - size + 1, np.minimum(counts, 1))
    place = np.cumsum(made) - made
    owner = np.repeat(np.arange(len(counts)), made)
    inside = np.arange(int(made.sum())) - place[owner]
    at = starts[owner] + inside
    out = np.zeros(len(owner), np.uint64)
    whole = long[owner]
    out[whole] = rolled[at[whole]]
    short = np.flatnonzero(~long & (counts > 0))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            has = counts[short] > i
            total[has] += hashes[starts[short[has]] + i] * _COEFFICIENTS[i]
        out[place[short]] = total + counts[short].astype(np.uint64) * _COEFFICIENTS[-2]
    return mix(out), made


def sequence_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's whole sequence of words, order included."""
    n = len(hashes)
    ends = np.cumsum(counts)
    starts = ends - counts
    power, inverse = _powers(n + 1)
    out = np.zeros((len(counts), 2), np.uint64)
    for k in range(2):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes + _COEFFICIENTS[10 + k]) * power[:n], out=sums[1:])
        out[:, k] = mix((sums[ends] - sums[starts]) * inverse[np.minimum(starts, max(n - 1, 0))] + counts.astype(np.uint64) * _COEFFICIENTS[12 + k])
    return out


def distinct(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles sorted and without repeats, and how many are left."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    first = np.ones(len(shingles), bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[first], np.bincount(owner[first], minlength=len(counts))
