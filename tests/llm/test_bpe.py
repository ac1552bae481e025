import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import ROWS
from txlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_of(transducer, text):
    return np.frombuffer(b"".join(bpe._stream(transducer, text)), "<u4").tolist()


def test_ids_are_the_library_s(library):
    transducer = bpe.BpeTransducer(bpe.vocabulary(PATH))
    drawn = random.Random(3)
    parts = [*"abeAB  \n\t\r'123éñ日　\x85\xa0\x1c!?.,|<>", "'s", "'ll", "tion", "<|endoftext|>", "  ", " \n", "ing", "🙂", "\U0001df2b", "a" * 40]
    for _ in range(1500):
        text = "".join(drawn.choices(parts, k=drawn.randint(0, 50)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(transducer, text) == ids
        state = bpe.ByteDecoder(transducer.vocabulary)
        assert "".join(state.feed([n]) for n in ids) + state.finish() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 70_001, "tion" * 30_000, "=-" * 40_000, "ab c" * 20_000 + "é" * 30_000, " " * 70_000 + "x"])
def test_long_pieces_go_through_windows(library, text):
    transducer = bpe.BpeTransducer(bpe.vocabulary(PATH))
    assert ids_of(transducer, text) == library.encode(text, add_special_tokens=False).ids


def test_feeding_in_parts_gives_the_same_ids(library):
    transducer = bpe.BpeTransducer(bpe.vocabulary(PATH))
    text = "The quick <|endoftext|> brown\n\n  fox's 12  jumps " * 50
    for size in (1, 7, 100):
        packed = b"".join([transducer.feed(text[at:at + size]) for at in range(0, len(text), size)]) + transducer.finish()
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_lookahead_follows_chains_of_stronger_merges():
    assert bpe.sufficient_lookahead([b"ab"]) == 2
    # "bc" may take the b of "ab" first, and "cd" the c of "bc" before that.
    assert bpe.sufficient_lookahead([b"cd", b"bc", b"ab"]) == 4
    assert bpe.sufficient_lookahead([b"ab", b"bc", b"cd"]) == 2


def test_decoder_holds_back_half_characters_and_replaces_bad_ones():
    class Words:
        bytes_of = {0: b"\xc3", 1: b"\xa9", 2: b"\xff"}

    state = bpe.ByteDecoder(Words)
    assert [state.feed([0]), state.feed([1]), state.feed([2]), state.feed([9]), state.feed([0]), state.finish()] == ["", "é", "�", "", "", "�"]


def test_every_row_round_trips(spark, edge, empty, library):
    rows = bpe.round_trip(edge, PATH, keep_text=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in rows) == sorted((i is None, i or 0, t or "") for i, t in ROWS)
    for row in rows:
        ids = library.encode(row.decoded, add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
    tokens = bpe.encode(edge, PATH)
    assert sorted(r.text for r in bpe.decode(tokens, PATH).collect()) == sorted(t or "" for _, t in ROWS)
    assert bpe.round_trip(empty, PATH).collect() == []
