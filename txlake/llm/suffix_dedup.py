"""Removal of byte strings that an earlier document has, by a difference cover of their places.

Two equal strings of ``length`` bytes at places i and j have a shift, below the cover's modulus, that takes both places
into the cover: the places whose rest belongs to a difference cover. So it is enough to name a sample of the suffixes,
six of every 31, by their first ``length - 30`` bytes and to sort those names: a string that repeats contains a sampled
name that repeats. As only prefixes of ``length`` bytes are ever compared, one round of names is deep enough and needs no
recursion. What is left, the unsampled suffixes near a repeated name, is then merged: sorted by the name of all
``length`` bytes, equal neighbours are repeats, and all but the earliest document's are removed. Documents that copy an
earlier one whole are known before and send nothing.

Names are 64-bit fingerprints (the sample's are cut to 32 bits and the bucket's, as a wrong hit there only costs work).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txlake.llm import blocks as B
from txlake.llm.schema_guard import pick
from txlake.llm.text_hash import CHUNK_BYTES, byte_values, windows

LENGTH = 50
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


@lru_cache
def difference_cover(most: int) -> tuple[int, np.ndarray]:
    """The modulus up to ``most`` with the fewest sampled places, and residues whose differences give every residue.

    A prime p gives a perfect cover of p + 1 residues modulo p² + p + 1; the residues are found by trying.
    """
    best = (1, np.zeros(1, np.int64))
    for p in (2, 3, 5):
        modulus = p * p + p + 1
        if modulus > most:
            continue

        def grow(chosen: list[int], seen: set[int]) -> list[int] | None:
            if len(chosen) == p + 1:
                return chosen
            for n in range(chosen[-1] + 1, modulus):
                new = {(n - c) % modulus for c in chosen} | {(c - n) % modulus for c in chosen}
                if len(new) == 2 * len(chosen) and not new & seen and (found := grow([*chosen, n], seen | new)):
                    return found
            return None

        best = (modulus, np.array(grow([0], {0}), np.int64))
    return best


class _Places:
    """Documents of a block in one row of bytes: where each begins, and fingerprints of its strings."""

    def __init__(self, texts: B.Texts, length: int):
        self.texts, self.length = texts, length
        self.modulus, self.cover = difference_cover(max(1, length // 2 + 6))
        self.sizes = np.array([len(t) for t in texts.bytes], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        self.joined = np.frombuffer(b"\n".join(texts.bytes), np.uint8)
        self.name = length - self.modulus + 1

    def _each(self, size: int, places: np.ndarray) -> np.ndarray:
        """Fingerprint of the ``size`` bytes at each of the ascending places, made slice by slice."""
        out = []
        for at in range(0, len(self.joined), CHUNK_BYTES):
            x, y = np.searchsorted(places, (at, at + CHUNK_BYTES))
            if y > x:
                out.append(windows(byte_values(self.joined[at:at + CHUNK_BYTES + size - 1]), size)[places[x:y] - at])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def sampled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, document and place of each sampled name."""
        longest = int(self.sizes.max(initial=0))
        grid = (np.arange(0, longest + 1, self.modulus)[:, None] + self.cover).ravel()
        counts = np.where(self.sizes >= self.length, np.searchsorted(grid, self.sizes - self.name, side="right"), 0)
        owners = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        places = self.begins[owners] + grid[within]
        return self._each(self.name, places), owners, places

    def near(self, owners: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of places at which a string may start that contains one of the given names."""
        begin = self.begins[owners]
        return B.merged(np.maximum(places - self.modulus + 1, begin), np.minimum(places + 1, begin + self.sizes[owners] - self.length + 1))

    def strings(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = B.spread(starts, ends)
        owners = np.repeat(np.searchsorted(self.begins, starts, side="right") - 1, ends - starts)
        return self._each(self.length, places), owners, places


def _finish(texts: B.Texts, sizes: np.ndarray, begins: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    owners = np.searchsorted(begins, starts, side="right") - 1
    cuts = np.searchsorted(owners, np.arange(len(sizes) + 1))
    removed, kept = np.zeros(len(sizes), np.int64), list(texts.bytes)
    for n in np.flatnonzero(np.diff(cuts)):
        data, at, parts = texts.bytes[n], 0, []
        for a, b in zip(starts[cuts[n]:cuts[n + 1]] - begins[n], ends[cuts[n]:cuts[n + 1]] - begins[n]):
            parts.append(data[at:a])
            at = b
            removed[n] += b - a
        kept[n] = b"".join([*parts, data[at:]])
    columns = [pa.array(texts.ids, pa.int64()), pa.array(sizes), pa.array(removed), pa.array(np.diff(cuts)), pa.array(kept, pa.binary())]
    return pa.table(columns, schema=_SCHEMA)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents without the bytes of every ``length``-byte string that also starts in a document with a smaller id.

    Strings are judged on the input; overlapping ones count, and matches never cross documents. Returns ``doc_id``,
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (bytes, not always whole characters).
    A null text is empty; rows without an id keep their text and match nothing; rows with equal ids don't match each
    other; other columns are ignored. ``length`` is at least 16.
    """
    if length < 16:
        raise ValueError("length must be at least 16")
    docs = pick(docs, doc_id="long", text="string")
    layout = B.plan(docs)
    blocks = B.in_blocks(docs, layout)

    def sample(texts: B.Texts) -> pa.Table:
        if texts.block < 0:
            return B.message_table([])
        keys, owners, _ = _Places(texts, length).sampled()
        keys, *_ = B.distinct(B.shortened(keys, layout, 3), owners)
        return B.message_table([*B.sent(keys, layout, texts.block, 3), *B.sent_documents(texts, layout)])

    def strings(texts: B.Texts, back: pa.Table) -> pa.Table:
        if texts.block < 0:
            return B.message_table([])
        at = _Places(texts, length)
        keys, owners, places = at.sampled()
        keys, which, first, last = B.distinct(B.shortened(keys, layout, 3), owners)
        copied = B.copies(texts, back, layout)
        repeated = (B.received(back, keys, layout) | (first != last))[which] & ~copied[owners]
        starts, ends = at.near(owners[repeated], places[repeated])
        keys, owners, _ = at.strings(starts, ends)
        keys, *_ = B.distinct(keys, owners)
        kept = np.concatenate(([len(starts)], starts, ends, np.flatnonzero(copied))).astype("<i8").tobytes()
        return B.message_table([*B.sent(keys, layout, texts.block, 6), (-1 - texts.block, texts.block, kept)])

    def cut(texts: B.Texts, back: pa.Table) -> pa.Table:
        at = _Places(texts, length)
        if texts.block < 0:
            return _finish(texts, at.sizes, at.begins, np.zeros(0, np.int64), np.zeros(0, np.int64))
        kept = np.frombuffer(B.note(back), "<i8")
        starts, ends, copied = np.split(kept[1:], (kept[0], 2 * kept[0]))
        copied = copied[at.sizes[copied] >= length]
        keys, owners, places = at.strings(starts, ends)
        keys, which, first, _ = B.distinct(keys, owners)
        ids = np.array(texts.ids, np.int64)
        later = B.received(back, keys, layout)[which] | (ids[owners] > ids[first[which]])
        # A copy's strings all start in the document that it copies.
        starts = np.concatenate((places[later], at.begins[copied]))
        ends = np.concatenate((places[later] + length, (at.begins[:-1] + at.sizes)[copied]))
        order = np.argsort(starts, kind="stable")
        return _finish(texts, at.sizes, at.begins, *B.merged(starts[order], ends[order]))

    names = B.answer(B.per_block(blocks, sample, B.MESSAGES), 3, earlier=False)
    repeats = B.answer(B.with_answers(blocks, names, strings, B.MESSAGES), 6, earlier=True)
    return B.with_answers(blocks, repeats, cut, _RESULT)
