"""Benchmark passages in documents by greedy string tiling over words, which also finds them in another order.

Five-word seeds of the benchmark items are looked up in every document. For an item whose seeds in a document could
cover enough of it, the two are tiled: of all matches of unmarked words (found by Karp-Rabin fingerprints of five words
and put together along their diagonals) the longest is marked, again and again, until none of five words is left. The
share of the item's words that tiles cover is the coverage.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txlake.llm.schema_guard import pick, text_bytes
from txlake.llm.text_hash import chunks, window_owner, windows, words

MIN_TILE = 5
COVERAGE = 0.6
BLOCK_BYTES = 16 << 20
_RESULT = "doc_id long, item_id long, item_words long, covered long, coverage double, tiles array<struct<item_word:long,doc_word:long,words:long>>"
_TILES = pa.list_(pa.struct([("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())]))
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered", pa.int64()),
    ("coverage", pa.float64()), ("tiles", _TILES)])
_PLAIN = bytes(0x20 if chr(n) in string.punctuation else n for n in range(256))


def plain(text: str | None) -> bytes:
    """Lower case, with ASCII punctuation as spaces: what words are taken from."""
    return (text or "").lower().encode().translate(_PLAIN)


def matches(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches of unmarked words: first word in the item, in the document, and length."""
    def open_windows(hashes, free):
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[least:] == taken[:-least]) if len(hashes) >= least else np.zeros(0, np.int64)
        return windows(hashes, least)[at], at

    (a, at_a), (b, at_b) = open_windows(item, free_item), open_windows(doc, free_doc)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, side="right")
    counts = high - low
    i = np.repeat(at_a, counts)
    j = at_b[order[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    if not len(i):
        return i, j, i
    new = np.concatenate(([True], (np.diff(i) != 1) | (np.diff(j - i) != 0)))
    heads = np.flatnonzero(new)
    return i[heads], j[heads], np.diff(np.append(heads, len(i))) + least - 1


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (word of the item, word of the document, length) that don't overlap, the longest first; ties go to the
    earliest in the item, then in the document."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    while True:
        i, j, size = matches(item, doc, free_item, free_doc, least)
        if not len(i):
            return found
        longest = size.max()
        order = np.lexsort((j, i))
        for n in order[size[order] == longest]:
            a, b = slice(i[n], i[n] + longest), slice(j[n], j[n] + longest)
            if free_item[a].all() and free_doc[b].all():
                free_item[a] = free_doc[b] = False
                found.append((int(i[n]), int(j[n]), int(longest)))


class _Items:
    """Benchmark items whose smallest tile has ``least`` words: their words, and which items have a seed where."""

    def __init__(self, ids: list[int], texts: list[bytes], least: int):
        self.ids, self.least = ids, least
        _, _, self.hashes, self.first = words(texts or [b""])
        places, owners = window_owner(self.first, least)
        seeds = windows(self.hashes, least)[places]
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.at, self.owner = seeds[order], places[order], owners[order]


def _by_tile(rows: list[tuple[int, str | None]], least: int) -> list[_Items]:
    """The items, put together by the words of their smallest tile: ``least``, or all words of an item that has fewer."""
    groups: dict[int, tuple[list[int], list[bytes]]] = {}
    for item, text in rows:
        text = plain(text)
        size = min(least, len(words([text])[0]))
        if size:
            ids, texts = groups.setdefault(size, ([], []))
            ids.append(item)
            texts.append(text)
    return [_Items(*group, size) for size, group in sorted(groups.items())]


def _finder(groups: list[_Items], coverage: float) -> Callable[[list[str | None]], Iterator[tuple]]:
    """What finds items in texts: number of the text, and the columns of ``leaks`` beside the id."""
    def of_document(items: _Items, hashes: np.ndarray, known: np.ndarray) -> list[tuple]:
        least = items.least
        low = np.searchsorted(items.seeds, known)
        high = np.searchsorted(items.seeds, known, side="right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
        rows = []
        for n in np.unique(items.owner[at]):
            a, b = items.first[n], items.first[n + 1]
            reach = np.zeros(b - a + 1, np.int64)
            mine = items.at[at[items.owner[at] == n]] - a
            reach[mine] += 1
            reach[mine + least] -= 1
            if (np.cumsum(reach) > 0).sum() < coverage * (b - a):
                continue  # no tiling can cover more words than seeds do
            tiles = tile(items.hashes[a:b], hashes, least)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * (b - a) - 1e-9:
                rows.append((items.ids[n], int(b - a), covered, covered / int(b - a), [dict(zip(("item_word", "doc_word", "words"), t)) for t in tiles]))
        return rows

    def find(texts: list[str | None]) -> Iterator[tuple]:
        for first, held in chunks(map(plain, texts)):
            _, _, hashes, begins = words(held)
            for items in groups:
                places, owners = window_owner(begins, items.least)
                found = windows(hashes, items.least)[places]
                near = np.searchsorted(items.seeds, found)
                hit = items.seeds[np.minimum(near, len(items.seeds) - 1)] == found
                for n in np.unique(owners[hit]):
                    known = np.unique(found[hit & (owners == n)])
                    for row in of_document(items, hashes[begins[n]:begins[n + 1]], known):
                        yield first + n, *row

    return find


def _scan(docs: DataFrame, groups: list[_Items], coverage: float) -> DataFrame:
    find = _finder(groups, coverage)

    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [(ids[n], *row) for n, *row in find(batch.column(1).to_pylist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return docs.mapInArrow(work, _RESULT)


def _drop(docs: DataFrame, groups: list[_Items], coverage: float) -> DataFrame:
    find, at, ids = _finder(groups, coverage), docs.columns.index("text"), docs.columns.index("doc_id")

    def work(batches):
        for batch in batches:
            keep, named = np.ones(batch.num_rows, bool), batch.column(ids).is_valid()
            keep[[n for n, *_ in find(batch.column(at).cast(pa.string()).to_pylist()) if named[n].as_py()]] = False
            yield from pa.Table.from_batches([batch]).filter(pa.array(keep)).to_batches()

    return docs.mapInArrow(work, docs.schema)


def _blocks(benchmark: DataFrame, least: int) -> Iterator[list[_Items]]:
    """The benchmark in blocks of at most ``BLOCK_BYTES`` of text, or one item."""
    benchmark = pick(benchmark, item_id="long", text="string")
    total = benchmark.agg(F.sum(text_bytes(benchmark))).first()[0] or 0
    count = max(1, math.ceil(2 * total / BLOCK_BYTES))
    blocks = benchmark.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for number in range(count):
        rows = [(r["item_id"], r["text"]) for r in blocks.where(F.col("block") == number).orderBy("item_id", "text").collect()]
        yield _by_tile(rows, least)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_TILE) -> DataFrame:
    """A row for every document and benchmark item of which tiles cover at least ``coverage``, with the tiles.

    Words are runs of other than ASCII white space and punctuation, in lower case; a tile has at least ``least`` of them,
    or all words of an item that has fewer; items without words match nothing. The benchmark is the query set: it goes to every task in blocks of at most
    ``BLOCK_BYTES`` of text (or one item), one pass over the documents per block. Null texts are empty; null ids are kept
    as they are; repeated rows repeat; other columns are ignored.
    """
    docs, found = pick(docs, doc_id="long", text="string"), None
    for groups in _blocks(benchmark, least):
        part = _scan(docs, groups, coverage)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents, with all their columns, in which no item is covered. Each row goes by its own text, also if other rows
    have its id. Rows without an id stay, whatever they hold; ``leaks`` reports them."""
    for groups in _blocks(benchmark, MIN_TILE):
        docs = _drop(docs, groups, coverage)
    return docs
