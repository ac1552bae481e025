"""Removal of repeated words and bytes, against a walk over all places."""

import re

from tests.llm.conftest import ROWS
from txlake.llm import substring_dedup, suffix_dedup


def removed(texts, units, size):
    """Per document: its units, and which are covered by a sequence that starts in a document of a smaller id."""
    split = [(doc, units(text)) for doc, text in texts]
    first = {}
    for doc, parts in split:
        for n in range(len(parts) - size + 1):
            key = tuple(parts[n:n + size])
            first[key] = min(doc, first.get(key, doc))
    for doc, parts in split:
        gone = [False] * len(parts)
        for n in range(len(parts) - size + 1):
            if first[tuple(parts[n:n + size])] < doc:
                gone[n:n + size] = [True] * size
        yield doc, parts, gone


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def check_words(rows, texts):
    expected = sorted((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)) for doc, w, gone in removed(texts, words, 13))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == expected
    for row in rows:
        assert sum(s.last - s.first + 1 for s in row.spans) == row.n_removed


def check_bytes(rows, texts):
    expected = []
    for doc, data, gone in removed(texts, str.encode, 50):
        runs = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        expected.append((doc, len(data), sum(gone), runs, bytes(x for x, g in zip(data, gone) if not g)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == sorted(expected)


def test_words_of_documents(documents, texts, small_blocks):
    check_words(substring_dedup.remove_repeats(documents).collect(), texts)


def test_words_with_long_prefixes(documents, texts, small_blocks):
    check_words(substring_dedup.remove_repeats(documents, group_suffixes=20).collect(), texts)


def test_bytes_of_documents(documents, texts, small_blocks):
    check_bytes(suffix_dedup.remove_repeats(documents).collect(), texts)


def test_edges(edge, empty, small_blocks):
    known = [(i, t or "") for i, t in ROWS if i is not None]
    whole = next(t for i, t in ROWS if i is None)
    rows = substring_dedup.remove_repeats(edge).collect()
    check_words([r for r in rows if r.doc_id is not None], known)
    assert [(r.n_removed, r.kept) for r in rows if r.doc_id is None] == [(0, whole)]
    rows = suffix_dedup.remove_repeats(edge).collect()
    check_bytes([r for r in rows if r.doc_id is not None], known)
    assert [(r.n_removed, bytes(r.kept)) for r in rows if r.doc_id is None] == [(0, whole.encode())]
    assert substring_dedup.remove_repeats(empty).collect() == []
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_covers_hold_every_difference():
    for most in (7, 13, 31, 60):
        modulus, cover = suffix_dedup.difference_cover(most)
        assert modulus <= most and {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))
