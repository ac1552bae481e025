"""Vectorized word and window fingerprints of UTF-8 text, and how documents are cut into chunks of bounded size.

Everything here is a small helper that runs inside one task, on one chunk of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit of the result depends on every bit put in."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def byte_values(data: np.ndarray) -> np.ndarray:
    """A scrambled 64-bit number for each byte."""
    return _BYTE[data]


_powers = np.ones(1, np.uint64)


def powers(count: int) -> np.ndarray:
    """The first ``count`` powers of the word multiplier."""
    global _powers
    if len(_powers) < count:
        steps = np.full(max(count, 2 * len(_powers)), _STEP)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:count]


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive documents of about ``limit`` bytes together, with the number of the first; a longer one stands alone."""
    held: list[bytes] = []
    size = first = 0
    for number, text in enumerate(texts):
        if held and size + len(text) > limit:
            yield first, held
            held, size, first = [], 0, number
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents joined by a line end: each word's start, end and fingerprint, and each document's first word.

    A word is a longest run without space, tab, line feed, vertical tab, form feed or carriage return. The last array
    has one entry more than there are documents.
    """
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = ~_WHITE[joined]
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(starts, begins)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), first
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    offset = np.arange(lengths.sum()) - np.repeat(at, lengths)
    values = _BYTE[joined[inside]] * powers(int(lengths.max()))[offset]
    return starts, ends, mix(np.add.reduceat(values, at) + lengths.astype(np.uint64)), first


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each ``size`` consecutive values, by doubling: about ``2 log2(size)`` passes."""
    count = len(values) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    spans, power = {1: values}, {1: _BASE}
    reach = 1
    while reach * 2 <= size:
        spans[reach * 2] = spans[reach][:-reach] * power[reach] + spans[reach][reach:]
        power[reach * 2] = power[reach] * power[reach]
        reach *= 2
    result, done = spans[reach][:count], reach
    for reach in sorted(spans, reverse=True):
        while size - done >= reach:
            result = result * power[reach] + spans[reach][done:done + count]
            done += reach
    return mix(result)


def window_owner(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of ``size`` words lie in one document: their numbers, and the document of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    return first[owner] + np.arange(counts.sum()) - at[owner], owner


np.seterr(over="ignore")
