"""Byte-pair encoding and decoding of whole documents in constant working memory.

Encoding is a streaming transducer. A merge list has a *sufficient lookahead*: how many bytes past the start of a
token decide that token whatever follows. ``sufficient_lookahead`` computes a bound of it from the merges alone, and
``BpeTransducer`` emits every token that starts at least that far before the end of what it has seen. Decoding is an
incremental state machine from token bytes to text. Neither ever holds more than a window of a document's tokens.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from txlake.llm.schema_guard import pick

# How the byte-level vocabulary splits text before merging. White space is spelled out, as libraries differ on it.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


# Letters and numbers of Unicode 17, which the tokenizers library does not know and splits off as signs.
_LATE = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f")
_HAS_LATE = regex.compile(f"[{_LATE}]")


_PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_LATE_PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_LATE}]]+| ?[\p{{N}}--[{_LATE}]]+"
    rf"| ?(?:[^{_SPACE}\p{{L}}\p{{N}}]|[{_LATE}])+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+", regex.V1)


def pieces(text: str) -> list[str]:
    """The pieces that merges never cross."""
    return (_LATE_PIECES if _HAS_LATE.search(text) else _PIECES).findall(text)


# White space, then what is not: a cut after such a run never lies inside a piece.
_RUNS = regex.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
# White space and a space after it: there a space doesn't begin a new run.
_UNEVEN = [c + " " for c in regex.findall(f"[{_SPACE}]", "".join(map(chr, range(0x3001))))]
_STREAM_CHARS = 1 << 16
_CACHE_ENTRIES = 1_000_000
_NONE = 1 << 30


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary file.

    Visible Latin-1 characters stand for themselves; the other bytes take the code points from 256 on, in order.
    """
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in visible}
    hidden = (b for b in range(256) if b not in set(visible))
    return table | {chr(256 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        symbols = byte_symbols()
        vocab = stored["model"]["vocab"]
        self.bytes_of = {number: bytes(symbols[c] for c in token) for token, number in vocab.items()}
        self.special = {t["content"]: t["id"] for t in stored.get("added_tokens", [])}
        self.bytes_of |= {number: content.encode() for content, number in self.special.items()}
        self.byte_id = {symbols[token]: number for token, number in vocab.items() if len(token) == 1}
        self.ranks: dict[int, int] = {}  # by left id << 32 | right id
        self.merged: list[int] = []
        for pair in stored["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[left] << 32 | vocab[right], len(self.merged))
            self.merged.append(vocab[left + right])
        # Only what merges make comes out of a text.
        self.id_of = {self.bytes_of[number]: number for number in {*self.byte_id.values(), *self.merged}}
        self.lookahead = sufficient_lookahead(
            [self.bytes_of[number] for number in self.merged])


def sufficient_lookahead(merged: list[bytes]) -> int:
    """Bytes from a token's start that decide the token, given the merge results in the order of their priority.

    Whether a merge happens at a place depends on its own bytes and on stronger merges that straddle its right end;
    whether those happen depends on stronger ones still. ``reach`` follows the longest such chain: for every prefix of
    the results so far it holds the bytes that the widest merge starting with that prefix may have to see.
    """
    reach: dict[bytes, int] = {}
    widest = 1
    for token in merged:
        size = len(token)
        need = max([size, *(size - n + reach.get(token[size - n:], 0) for n in range(1, size))])
        widest = max(widest, need)
        for n in range(1, size):
            prefix = token[:n]
            if reach.get(prefix, 0) < need:
                reach[prefix] = need
    return widest


class BpeTransducer:
    """Encoder of one stream: ``feed`` takes text and returns the packed ids that are certain, ``finish`` the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.held = ""
        self.known: dict[str, bytes] = _Known(self.run)
        self.spaced: dict[str, bytes] = _Known(lambda run: self.run(" " + run))
        self.pieces: dict[str, bytes] = _Known(lambda piece: b"".join(map(_pack, self.piece(piece.encode()))))
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.beside: dict[int, bool] = _Known(self._fits)
        # A list is proper if all that it makes comes back from its own bytes; only then do neighbours decide a sequence.
        self.proper = all(self._merge(vocabulary.bytes_of[number]) == [number] for number in set(vocabulary.merged))
        self.longest_special = max(map(len, vocabulary.special), default=0)

    def feed(self, text: str) -> bytes:
        """Ids, four bytes each, of what no later text can change."""
        held = self.held + text
        cut = self._certain(held)
        self.held = held[cut:]
        return self.encode(held[:cut])

    def finish(self) -> bytes:
        held, self.held = self.held, ""
        return self.encode(held)

    def _certain(self, text: str) -> int:
        """A cut between a character and white space after it; special tokens may still grow across the last few."""
        limit = len(text) - self.longest_special
        for at in range(limit, 0, -1):
            if text[at].isspace() and not text[at - 1].isspace():
                return at
        return 0

    def encode(self, text: str) -> bytes:
        if self.split_special is None or not self.split_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.split_special.finditer(text):
            out.append(self._plain(text[at:found.start()]))
            out.append(_pack([self.vocabulary.special[found[0]]]))
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        for known in (self.known, self.spaced, self.pieces, self.beside):
            if len(known) > _CACHE_ENTRIES:
                known.clear()
        if any(pair in text for pair in _UNEVEN):
            return b"".join(map(self.known.__getitem__, _RUNS.findall(text)))
        head, *rest = text.split(" ")
        return self.known[head] + b"".join(map(self.spaced.__getitem__, rest))

    def run(self, text: str) -> bytes:
        """A run of text that starts and ends where pieces do."""
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():
            found = [text] if not _HAS_LATE.search(text) else pieces(text)
        elif body[:-1].isalpha() and body[-1] in ".,":
            found = [text[:-1], body[-1]]
        else:
            found = pieces(text)
        return b"".join(map(self.pieces.__getitem__, found))

    def piece(self, data: bytes) -> Iterator[list[int]]:
        """Ids of one piece; a long one goes through a window, and tokens leave it once they are stable."""
        stable, at = self.vocabulary.lookahead, 0
        while len(data) - at > 4 * stable:
            ids, kept, size = self._merge(data[at:at + 4 * stable]), [], 0
            for number in ids:
                if size > 3 * stable:
                    break
                kept.append(number)
                size += len(self.vocabulary.bytes_of[number])
            yield kept
            at += size
        yield self._short(data[at:]) if self.proper and len(data) <= 64 else self._merge(data[at:])

    def _short(self, data: bytes) -> list[int]:
        """The ids of a short piece, left to right: each is the longest that stands beside the one before it.

        Two ids stand side by side if merging their bytes gives them back; the sequence in which all neighbours do is
        the one that merging by priority gives. Where no id fits, the one before it is taken shorter.
        """
        id_of, beside = self.vocabulary.id_of, self.beside
        ids: list[int] = []
        ends = [0]
        size = len(data)
        stop = size
        while True:
            at = ends[-1]
            for end in range(stop, at, -1):
                number = id_of.get(data[at:end])
                if number is not None and (not ids or beside[ids[-1] << 32 | number]):
                    ids.append(number)
                    ends.append(end)
                    break
            else:
                stop = ends.pop() - 1
                ids.pop()
                continue
            if end == size:
                return ids
            stop = size

    def _fits(self, pair: int) -> bool:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        return self._merge(self.vocabulary.bytes_of[left] + self.vocabulary.bytes_of[right]) == [left, right]

    def _merge(self, data: bytes) -> list[int]:
        """The merges applied in the order of their priority, leftmost first."""
        byte_id, rank_of, merged = self.vocabulary.byte_id, self.vocabulary.ranks.get, self.vocabulary.merged
        ids = [byte_id[b] for b in data]
        if len(ids) > 64:
            return self._merge_long(ids)
        ranks = [rank_of(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < _NONE:
            n = ranks.index(best)
            ids[n:n + 2] = [merged[best]]
            del ranks[n]
            if n:
                ranks[n - 1] = rank_of(ids[n - 1] << 32 | ids[n], _NONE)
            if n < len(ranks):
                ranks[n] = rank_of(ids[n] << 32 | ids[n + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links between neighbours, for windows of thousands of bytes."""
        rank_of, merged = self.vocabulary.ranks.get, self.vocabulary.merged
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        queue = [(rank, n) for n, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := rank_of(a << 32 | b, _NONE)) < _NONE]
        heapq.heapify(queue)
        gone = [False] * len(ids)
        while queue:
            rank, n = heapq.heappop(queue)
            right = after[n]
            if gone[n] or right < 0 or rank_of(ids[n] << 32 | ids[right]) != rank:
                continue
            ids[n], gone[right], after[n] = merged[rank], True, after[right]
            if after[right] >= 0:
                before[after[right]] = n
            for a, b in ((before[n], n), (n, after[n])):
                if a >= 0 and b >= 0 and (found := rank_of(ids[a] << 32 | ids[b], _NONE)) < _NONE:
                    heapq.heappush(queue, (found, a))
        return [number for number, dropped in zip(ids, gone) if not dropped]


class _Known(dict):
    """Results for ids and short texts seen before, for as long as the owner keeps them."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        made = self.make(key)
        if isinstance(key, int) or len(key) <= 64:
            self[key] = made
        return made


class ByteDecoder:
    """Text of a stream of ids: bytes that don't yet end a character wait; bytes that can't become one are replaced."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """Ids that the vocabulary lacks stand for nothing."""
        try:
            data = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            data = b"".join(self.bytes_of.get(n, b"") for n in ids)
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def _transducer(path: str) -> BpeTransducer:
    return BpeTransducer(vocabulary(path))


def _stream(transducer: BpeTransducer, text: str) -> Iterator[bytes]:
    if len(text) <= _STREAM_CHARS:
        yield transducer.encode(text)
        return
    for at in range(0, len(text), _STREAM_CHARS):
        yield transducer.feed(text[at:at + _STREAM_CHARS])
    yield transducer.finish()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``token_ids`` of every whole text, a null text counting as an empty one.

    ``path`` names a vocabulary file present on every executor. Rows repeat if ids do; other columns are ignored.
    """
    def work(batches):
        transducer = _transducer(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for doc, text in zip(ids, texts):
                packed = b"".join(_stream(transducer, text.as_py() or ""))
                tokens = pa.array([np.frombuffer(packed, "<u4").astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), tokens], ["doc_id", "token_ids"])

    return pick(docs, doc_id="long", text="string").mapInArrow(work, "doc_id long, token_ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of every row of ``doc_id``, ``token_ids``; null ids give an empty text."""
    def work(batches):
        words = vocabulary(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                state = ByteDecoder(words)
                values = ids.values.to_pylist() if ids.is_valid else []
                texts.append(state.feed(n for n in values if n is not None) + state.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(tokens, doc_id="long", token_ids="array<int>").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, keep_text: bool = False) -> DataFrame:
    """Every text encoded, and its ids decoded again, in one pass over the rows.

    Returns ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian 32-bit integers) and
    ``decoded_sha256`` (of the decoded text in UTF-8); with ``keep_text`` also ``decoded``. Ids are hashed and decoded
    window by window, so a document of any length needs no more than its text. A null text counts as an empty one, a
    null ``doc_id`` is kept, repeated rows repeat, and a table without rows gives none.
    """
    def one(transducer: BpeTransducer, text: str) -> tuple:
        state, size = ByteDecoder(transducer.vocabulary), 0
        of_ids, of_text, kept = hashlib.sha256(), hashlib.sha256(), []
        for packed in _stream(transducer, text):
            size += len(packed) // 4
            of_ids.update(packed)
            part = state.feed(memoryview(packed).cast("I"))
            of_text.update(part.encode())
            if keep_text:
                kept.append(part)
        rest = state.finish()
        of_text.update(rest.encode())
        return size, of_ids.hexdigest(), of_text.hexdigest(), "".join([*kept, rest])

    def work(batches):
        transducer = _transducer(path)
        for batch in batches:
            rows = [one(transducer, text or "") for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.string()] * keep_text
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["decoded"] * keep_text
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * keep_text
    return pick(docs, doc_id="long", text="string").mapInArrow(work, schema)
