"""Removal of word sequences that an earlier document has, by suffix trees of prefix-partitioned suffixes.

A suffix is the rest of a document from one of its words on. All suffixes together would be one tree, too large for any
machine; split by their first words they are many subtrees. Prefixes are of variable length: one word, and for prefixes
with more suffixes than a task should hold 2, 4, 8 and so on up to ``min_words``. A subtree is built as sorted suffixes
with the lengths of the prefixes that neighbours share; its nodes at depth ``min_words`` or more are the repeats.

Suffixes that hang alone below a shallow node can't be repeats. They are most of the corpus, and a first exchange of
short fingerprints of ``min_words`` words leaves them out. Identical suffixes of a block count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txlake.llm import blocks as B
from txlake.llm.schema_guard import durable, pick
from txlake.llm.text_hash import chunks, mix, window_owner, windows, words

MIN_WORDS = 13
GROUP_SUFFIXES = 1 << 19
_RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,last:long>>"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", _SPAN)])


class _Words:
    """Words of a block's documents one after the other: fingerprints, places in the text, and windows of ``depth``."""

    def __init__(self, texts: B.Texts, depth: int):
        self.texts, self.depth = texts, depth
        hashes, self.spans, first, done = [], [], [], 0
        for _, held in chunks(texts.bytes):
            starts, ends, found, begins = words(held)
            hashes.append(found)
            at = np.cumsum([0, *(len(t) + 1 for t in held)])
            for n in range(len(held)):
                x, y = begins[n], begins[n + 1]
                self.spans.append((starts[x:y] - at[n], ends[x:y] - at[n]))
            first.append(begins[:-1] + done)
            done += len(found)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.concatenate([*first, [done]]).astype(np.int64)
        self.windows = windows(self.hashes, depth)
        self.places, self.owners = window_owner(self.first, depth)

    def names(self, places: np.ndarray) -> np.ndarray:
        """The suffixes at the places: their first ``depth`` words as 16-bit names, which order the tree; keys tell
        suffixes of equal names apart."""
        short = (self.hashes >> np.uint64(48)).astype("<u2")
        return np.lib.stride_tricks.sliding_window_view(short, self.depth)[places]

    def groups(self, places: np.ndarray, heavy: list[np.ndarray], lengths: list[int]) -> np.ndarray:
        """The prefix that each suffix is grouped by: the shortest that isn't heavy."""
        chosen = prefix_keys(self.hashes, lengths[0])[places]
        for level, length in enumerate(lengths[1:]):
            longer = np.isin(chosen, heavy[level])
            if longer.any():
                chosen[longer] = prefix_keys(self.hashes, length)[places[longer]]
        return chosen


def prefix_keys(hashes: np.ndarray, length: int) -> np.ndarray:
    return mix(windows(hashes, length) + np.uint64(length))


def prefix_lengths(depth: int) -> list[int]:
    lengths = [1]
    while lengths[-1] * 2 < depth:
        lengths.append(lengths[-1] * 2)
    return [*lengths, depth]


def deep_nodes(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes in the tree, and at each the length of the prefix it shares with the one before it.

    Suffixes whose keys differ are held apart even if all their names agree.
    """
    order = np.lexsort((keys, *names.T[::-1]))
    a, b = names[order[:-1]], names[order[1:]]
    shared = np.where((a != b).any(1), (a != b).argmax(1), names.shape[1])
    shared = np.where((shared == names.shape[1]) & (keys[order[:-1]] != keys[order[1:]]), names.shape[1] - 1, shared)
    return order, np.concatenate(([0], shared))[:len(order)]


def _answer(messages: DataFrame, depth: int) -> DataFrame:
    """Builds the subtrees of a bucket's prefixes; a suffix below a deep node that an earlier block has too gets a 1."""
    def work(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        if bucket < 0:
            return rows.select(["bucket", "block", "payload"])
        order = np.argsort(rows.column("block").to_numpy(), kind="stable")
        blocks, payloads = rows.column("block").to_numpy()[order], rows.column("payload")
        parts = [np.frombuffer(payloads[int(n)].as_py(), "<u2").reshape(-1, depth + 4) for n in order]
        cuts = np.cumsum([0, *map(len, parts)])
        table = np.concatenate(parts)
        keys = np.ascontiguousarray(table[:, depth:]).view("<u8").ravel()
        tree, shared = deep_nodes(table[:, :depth], keys)
        node = np.cumsum(shared < depth) - 1
        first = np.full(node[-1] + 1, len(table))
        np.minimum.at(first, node, tree)
        bits = np.empty(len(table), bool)
        bits[tree] = tree > first[node]
        return B.message_table([(bucket, int(b), np.packbits(bits[x:y]).tobytes()) for b, x, y in zip(blocks, cuts[:-1], cuts[1:])])

    return durable(messages.groupBy("bucket").applyInArrow(work, B.MESSAGES), "subtrees")


def _heavy(counts: DataFrame, lengths: list[int], most: int) -> list[np.ndarray]:
    """Prefixes with more than ``most`` suffixes, by length; at most suffixes / ``most`` of each length."""
    rows = counts.groupBy("level", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
    return [np.array([r["prefix"] for r in rows if r["level"] == n], np.int64).view(np.uint64) for n in range(len(lengths) - 1)]


def _prefix_counts(notes: DataFrame) -> DataFrame:
    kind = pa.schema([("level", pa.int32()), ("prefix", pa.int64()), ("n", pa.int64())])

    def work(batches):
        for batch in batches:
            for note in batch.column(0):
                level, prefix, n = np.frombuffer(note.as_py(), "<i8").reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(prefix), pa.array(n)], schema=kind)

    return notes.select("payload").mapInArrow(work, "level int, prefix long, n long")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """Documents without the words of every ``min_words`` words in a row that also start in a document of a smaller id.

    Words are runs without ASCII white space, unchanged; sequences are judged on the input. Returns ``doc_id``,
    ``n_words``, ``n_removed``, ``kept`` (words joined by one space) and ``spans`` (first and last word, counted from 0,
    of each removed run). A null text has no words; rows without an id stay whole; rows of equal ids don't match each
    other; other columns are ignored. ``min_words`` is at least 2.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    docs = pick(docs, doc_id="long", text="string")
    layout = B.plan(docs)
    blocks = B.in_blocks(docs, layout)
    lengths = prefix_lengths(min_words)
    share = max(1, group_suffixes // layout.blocks)

    def fingerprints(texts: B.Texts) -> pa.Table:
        if texts.block < 0:
            return B.message_table([])
        at = _Words(texts, min_words)
        keys, *_ = B.distinct(B.shortened(at.windows[at.places], layout, 3), at.owners)
        notes, places = [], at.places
        for level, length in enumerate(lengths[:-1]):
            found, which, counts = np.unique(prefix_keys(at.hashes, length)[places], return_inverse=True, return_counts=True)
            many = counts >= share
            notes.append(np.stack([np.full(many.sum(), level, "<i8"), found[many].view(np.int64), counts[many]]))
            places = places[many[which]]
        return B.message_table([
            *B.sent(keys, layout, texts.block, 3), (-1 - texts.block, texts.block, np.concatenate(notes, 1).astype("<i8").tobytes())])

    def places_of(at: _Words, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at.places[repeated], at.owners[repeated]

    def ordered(at: _Words, places: np.ndarray, owners: np.ndarray, heavy: list[np.ndarray]):
        """Distinct suffixes by bucket: their keys' places in that order, and for each place its suffix."""
        keys, which, first, _ = B.distinct(at.windows[places], owners)
        sample = np.zeros(len(keys), np.int64)
        sample[which[::-1]] = places[::-1]
        groups = at.groups(sample, heavy, lengths) if len(keys) else keys
        order = np.lexsort((keys, groups >> np.uint64(64 - layout.bits)))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        return keys[order], groups[order], sample[order], rank[which], first[order]

    def suffixes(texts: B.Texts, back: pa.Table, heavy: list[np.ndarray]) -> pa.Table:
        if texts.block < 0:
            return B.message_table([])
        at = _Words(texts, min_words)
        keys, which, first, last = B.distinct(B.shortened(at.windows[at.places], layout, 3), at.owners)
        repeated = np.flatnonzero((B.received(back, keys, layout) | (first != last))[which])
        keys, groups, sample, _, _ = ordered(at, *places_of(at, repeated), heavy)
        out = []
        if len(keys):
            table = np.concatenate((at.names(sample), keys.astype("<u8").view("<u2").reshape(-1, 4)), 1)
            out = [(bucket, texts.block, table[part].tobytes()) for bucket, part in B.split_buckets(groups, layout.bits)]
        return B.message_table([*out, (-1 - texts.block, texts.block, repeated.astype("<i8").tobytes())])

    def cut(texts: B.Texts, back: pa.Table, heavy: list[np.ndarray]) -> pa.Table:
        at = _Words(texts, min_words)
        removed = np.zeros(len(at.hashes) + 1, np.int64)
        if texts.block >= 0:
            places, owners = places_of(at, np.frombuffer(B.note(back), "<i8"))
            keys, groups, _, which, first = ordered(at, places, owners, heavy)
            ids = np.array(texts.ids, np.int64)
            later = places[B.received(back, groups, layout)[which] | (ids[owners] > ids[first[which]])]
            starts, ends = B.merged(later, later + min_words)
            removed[starts] += 1
            removed[ends] -= 1
        gone = np.cumsum(removed[:-1]) > 0
        rows = []
        for n, (doc, data) in enumerate(zip(texts.ids, texts.bytes)):
            mine = gone[at.first[n]:at.first[n + 1]]
            starts, ends = at.spans[n]
            keep = np.flatnonzero(~mine)
            kept = b" ".join([data[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())]).decode()
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
            spans = [{"first": a, "last": b - 1} for a, b in edges.reshape(-1, 2).tolist()]
            rows.append((doc, len(mine), int(mine.sum()), kept, spans))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    shared = B.answer(B.per_block(blocks, fingerprints, B.MESSAGES), 3, earlier=False)
    heavy = _heavy(_prefix_counts(shared.where("bucket < 0")), lengths, group_suffixes)
    trees = _answer(B.with_answers(blocks, shared, lambda t, b: suffixes(t, b, heavy), B.MESSAGES), min_words)
    return B.with_answers(blocks, trees, lambda t, b: cut(t, b, heavy), _RESULT)
