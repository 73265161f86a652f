import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import awkward, noisy_copies
from tidemark.llm.bpe import Decoder, Merges, Transducer, encode

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def merges():
    return Merges.load(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_equals_library(spark, make_docs, library):
    r = random.Random(1)
    parts = ["a", "th", "é", "Σ", " ", "\t", "\x85", "\u2028", "'s", "'", "#", "1", "१", "İ", "ß", "\u0301", "<|endoftext|>", "<|startoftext|>", "<|", "中", "🦄", "\u200b", "\x1c", "K"]
    rows = noisy_copies(3, 20, 3) + awkward() + [(500 + i, "".join(r.choices(parts, k=200))) for i in range(100)]
    rows += [(900, "the" * 9000), (901, "%" * 5000 + "=-" * 4000), (902, "1" * 3000)]
    got = sorted(((x.doc_id, x.n_tokens, np.frombuffer(x.ids, "<u4").tolist(), x.decoded) for x in encode(make_docs(rows), FILE).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert encode(make_docs([]), FILE).collect() == []


@pytest.mark.parametrize("alphabet", ["ab", "thein", "a", "aé中"])
def test_transducer_is_stable_and_bounded(merges, library, alphabet):
    """Tokens given out early are never taken back, and the buffer does not grow with the piece."""
    r, ahead = random.Random(alphabet), merges.lookahead()
    for size in (1, ahead - 1, ahead, ahead + 1, 5000):
        piece = "".join(r.choices(alphabet, k=size))
        machine, out = Transducer(merges, ahead, part=64), []
        for t in machine.feed(piece.encode()):
            out += t.tolist()
            assert len(machine.buffer) <= ahead + 64 + 32
        out += machine.finish().tolist()
        assert out == library.encode(piece, add_special_tokens=False).ids


def test_decoder_in_parts(merges, library):
    ids = library.encode("some words, and 123 more!", add_special_tokens=False).ids
    decoder = Decoder(merges.tokens)
    assert "".join(decoder.feed(ids[i: i + 2]) for i in range(0, len(ids), 2)) == library.decode(ids, skip_special_tokens=False)
