"""Texts without white space, encoded a segment at a time: ids equal to the library's, in memory that does not grow with the text."""

import random
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cyclelens.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
KINDS = {
    "chinese": "的一是不了人我在有他这为之大来以个中上们",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "code": "abc(){}[];'\"=+.,'s't're",
    "marks": "aeọ́̂xyz'é한عّ",
    "punctuation": "!?-'.#",
    "capitals": "ÀÉÎÕÜİΣΑß'sT",
}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(autouse=True)
def short_segments(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 37)


@pytest.mark.parametrize("kind", KINDS)
def test_ids_across_segments(library, kind):
    rng = random.Random(kind)
    encoder, _ = bpe.loaded(PATH)
    for n in (90, 400, 3_000):
        text = "".join(rng.choice(KINDS[kind]) for _ in range(n))
        for mixed in (text, f"some words {text}", f"{text} {text}\n more", f"{text[:50]}<|endoftext|>{text}", f"  {text}  "):
            want = library.encode(mixed, add_special_tokens=False).ids
            data = b"".join(encoder.ids(mixed, 40))
            assert memoryview(data).cast("I").tolist() == want


def test_pieces_of_a_long_run(library):
    encoder, _ = bpe.loaded(PATH)
    text = "".join(random.Random(5).choice(KINDS["base64"]) for _ in range(300_000))
    pieces, total = packing._cut(text, encoder)
    assert total == len(library.encode(text, add_special_tokens=False).ids) + 1 == sum(p[1] for p in pieces)


@pytest.mark.parametrize("kind", ["chinese", "base64"])
def test_memory_stays(monkeypatch, kind):
    """Eight times the text, the same peak; the table of words seen has its own bound, so it is kept small here."""
    monkeypatch.setattr(bpe, "SEGMENT", 1 << 12)
    monkeypatch.setattr(bpe, "STRETCH", 1 << 12)
    merges, decoder = bpe.Merges(PATH), bpe.loaded(PATH)[1]
    rng, peaks = random.Random(7), []
    for n in (40_000, 320_000):
        encoder = bpe.Encoder(merges)
        encoder.limit = encoder.known.limit = 500
        text = "".join(rng.choices(KINDS[kind], k=n))
        tracemalloc.start()
        bpe.digest(text, encoder, decoder)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
