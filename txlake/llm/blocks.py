"""Documents in blocks of consecutive ids, and the exchange of packed fingerprints between blocks.

Substring operators compare every place of every document with all others. A row per place would cost tens of times the
text, so a block of documents sends its *distinct* fingerprints as sorted, packed arrays, one per range of the
fingerprint space (a bucket), and gets one bit back for each. What a block has many times it sends once, so a bucket
holds at most one entry per block for the most frequent passage of the corpus.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from txlake.llm.schema_guard import durable, pick, text_bytes

BLOCK_BYTES = 4 << 20
MOST_BLOCK_BYTES = 64 << 20
BUCKET_BYTES = 8 << 20
EARLIER = 1 << 40
MESSAGES = "bucket long, block long, payload binary"
_MESSAGE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])


class Layout:
    """Where blocks begin and how many bits name a bucket. Grows with the input: 8 bytes per block, on the driver too."""

    def __init__(self, starts: np.ndarray, total: int):
        self.starts = starts
        self.blocks = len(starts) + 1
        self.bits = max(8, math.ceil(math.log2(max(1, total) / BUCKET_BYTES)) if total else 8)


def plan(docs: DataFrame, name: str = "text") -> Layout:
    """Blocks of about equally many documents, about ``BLOCK_BYTES`` each; larger ones for a large corpus, so that the
    number of messages (blocks times buckets) stays in proportion."""
    row = docs.agg(F.sum(text_bytes(docs, name)).alias("bytes"), F.count("doc_id").alias("n")).first()
    total, ids = row["bytes"] or 0, row["n"]
    size = min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, total // 3000))
    count = max(1, math.ceil(total / size))
    if count == 1 or not ids:
        return Layout(np.zeros(0, np.int64), total)
    cuts = docs.agg(F.percentile_approx("doc_id", [n / count for n in range(1, count)], max(10_000, 20 * count)).alias("cuts")).first()["cuts"]
    return Layout(np.unique(np.array(cuts, np.int64)), total)


def in_blocks(docs: DataFrame, layout: Layout) -> DataFrame:
    """``block``, ``doc_id`` and ``text``; documents of one block have consecutive ids, those without an id block -1."""
    starts = layout.starts

    @F.pandas_udf(LongType())
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(starts, ids.fillna(0).astype("int64"), side="right")))

    return pick(docs, doc_id="long", text="string").select(block("doc_id").alias("block"), "doc_id", "text")


class Texts:
    """The documents of one block in the order of their ids, with their UTF-8 bytes."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("doc_id").to_pylist()
        texts = rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda n: (ids[n] is not None, ids[n] or 0))
        self.block = rows.column("block")[0].as_py()
        self.ids = [ids[n] for n in order]
        self.bytes = [(texts[n] or "").encode() for n in order]


def message_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _MESSAGE)], schema=_MESSAGE)


def split_buckets(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Sorted keys by their first ``bits`` bits: each bucket with its part."""
    owner = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(keys)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(owner[a]), slice(a, b)


def pack(values: np.ndarray, width: int) -> bytes:
    """Sorted numbers below 2^(8 + 8 width) in ``width`` bytes each, and counts of how many share the byte above."""
    plain = np.ascontiguousarray(values.astype("<u8"))
    raw = plain.view(np.uint8).reshape(-1, 8)
    if len(values) < 1024:
        return b"\0" + raw[:, :width + 1].tobytes()
    counts = np.bincount((plain >> np.uint64(8 * width)).astype(np.int64), minlength=256)
    return b"\1" + counts.astype("<u4").tobytes() + raw[:, :width].tobytes()


def unpack(payload: bytes, width: int) -> np.ndarray:
    size = width + (payload[0] == 0)
    at = 1 if payload[0] == 0 else 1025
    low = np.frombuffer(payload, np.uint8, offset=at).reshape(-1, size)
    values = np.zeros((len(low), 8), np.uint8)
    values[:, :size] = low
    values = values.view("<u8").ravel()
    if payload[0]:
        high = np.repeat(np.arange(256, dtype=np.uint64), np.frombuffer(payload, "<u4", 256, 1))
        values |= high << np.uint64(8 * width)
    return values


def sent(keys: np.ndarray, layout: Layout, block: int, width: int) -> list[tuple[int, int, bytes]]:
    """Messages of a block's sorted distinct keys, of which the first ``bits + 8 + 8 width`` bits count."""
    drop = max(0, 64 - layout.bits - 8 - 8 * width)
    mask = np.uint64((1 << (64 - layout.bits - drop)) - 1)
    return [(bucket, block, pack(keys[part] >> np.uint64(drop) & mask, width)) for bucket, part in split_buckets(keys, layout.bits)]


def shortened(keys: np.ndarray, layout: Layout, width: int) -> np.ndarray:
    """Keys with only the bits that ``sent`` sends."""
    drop = np.uint64(max(0, 64 - layout.bits - 8 - 8 * width))
    return keys >> drop << drop


def answer(messages: DataFrame, width: int, earlier: bool) -> DataFrame:
    """A bit for each key sent, as messages to the blocks: another block has it, or with ``earlier`` one before it.

    Messages with a negative bucket are notes of a block to itself; they come back as they are. Buckets from ``EARLIER``
    on hold whole keys and always ask for earlier blocks.
    """
    def work(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        if bucket < 0:
            return rows.select(["bucket", "block", "payload"])
        order = np.argsort(rows.column("block").to_numpy(), kind="stable")
        blocks = rows.column("block").to_numpy()[order]
        payloads = rows.column("payload")
        whole = bucket >= EARLIER
        parts = [unpack(payloads[int(n)].as_py(), 6 if whole else width) for n in order]
        cuts = np.cumsum([0, *map(len, parts)])
        bits = marked(np.concatenate(parts), earlier or whole)
        return message_table([(bucket, int(b), np.packbits(bits[x:y]).tobytes()) for b, x, y in zip(blocks, cuts[:-1], cuts[1:])])

    return durable(messages.groupBy("bucket").applyInArrow(work, MESSAGES), "answers")


def marked(values: np.ndarray, earlier: bool) -> np.ndarray:
    """Of sorted parts one after the other: which values occur in another part, or in an earlier one."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(values), bool)
    flags[1:] = same
    if not earlier:
        flags[:-1] |= same
    out = np.empty(len(values), bool)
    out[order] = flags
    return out


def received(rows: pa.Table, keys: np.ndarray, layout: Layout, first_bucket: int = 0) -> np.ndarray:
    """The bits that a block gets back, in the order of its sorted keys. ``first_bucket``: that of the smallest keys."""
    by_bucket = dict(zip(rows.column("bucket").to_pylist(), rows.column("payload").to_pylist()))
    bits = np.zeros(len(keys), bool)
    for bucket, part in split_buckets(keys, layout.bits):
        bits[part] = np.unpackbits(np.frombuffer(by_bucket[first_bucket + bucket], np.uint8), count=part.stop - part.start).astype(bool)
    return bits


def note(rows: pa.Table) -> bytes:
    """What the block wrote to itself."""
    return next(p for b, p in zip(rows.column("bucket").to_pylist(), rows.column("payload").to_pylist()) if b < 0)


def document_keys(texts: Texts) -> np.ndarray:
    """A 64-bit fingerprint of each whole document."""
    return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts.bytes], np.uint64)


def sent_documents(texts: Texts, layout: Layout) -> list[tuple[int, int, bytes]]:
    """Messages that ask which documents an earlier block has whole."""
    keys, *_ = distinct(document_keys(texts), np.arange(len(texts.ids)))
    return [(EARLIER + bucket, block, payload) for bucket, block, payload in sent(keys, layout, texts.block, 6)]


def copies(texts: Texts, back: pa.Table, layout: Layout) -> np.ndarray:
    """Which documents are exact copies of one with a smaller id."""
    keys, which, first, _ = distinct(document_keys(texts), np.arange(len(texts.ids)))
    ids = np.array(texts.ids, np.int64)
    return received(back, keys, layout, EARLIER)[which] | (ids > ids[first[which]])


def distinct(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys; which of them each entry has; the first and the last owner of each. Owners ascend."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    tails = np.concatenate((heads[1:], [len(keys)]))[:len(heads)] - 1
    return ordered[heads], which, owners[order][heads], owners[order][tails]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges (end exclusive) whose starts and ends both ascend, with touching ones put together; empty ones go."""
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return starts, ends
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return starts[new], ends[last]


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers in the ranges."""
    lengths = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum()) if len(starts) else np.zeros(0, np.int64)


def per_block(blocks: DataFrame, work: Callable[[Texts], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("block").applyInArrow(lambda rows: work(Texts(rows)), schema)


def with_answers(blocks: DataFrame, answers: DataFrame, work: Callable[[Texts, pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda rows, back: work(Texts(rows), back), schema)
