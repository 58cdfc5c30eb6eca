"""Words of familiar characters are taken from a stretch at once: each distinct word is encoded once, whatever stands beside it."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from cyclelens.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["Word", "wörd", "it's", "DON'T", "x's't", "12a3", "--", "\u00a0", "\x85", "\x1c", "\x1f", "\t\n", "e\u0301", "\u0301", "İ", "Σ", "的", "\u2003", "<|endoftext|>", "<|", "q" * 90, "ß", "'", ",", ""]


def test_ids_equal_the_librarys():
    library, rng = Tokenizer.from_file(PATH), random.Random(11)
    encoders = bpe.Encoder(bpe.Merges(PATH)), packing.LibraryEncoder(PATH)
    for n in range(3_000):
        # A third has no unfamiliar character, a third a few, the rest any.
        chosen = [p for p in PARTS if n % 3 or p.isascii() and "<" not in p]
        text = "".join(rng.choice(chosen) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(30)))
        want = library.encode(text, add_special_tokens=False).ids
        for encoder in encoders:
            assert memoryview(b"".join(encoder.ids(text, 40))).cast("I").tolist() == want, text


def test_a_word_is_encoded_once(monkeypatch):
    encoded = []
    for encoder in bpe.Encoder(bpe.Merges(PATH)), packing.LibraryEncoder(PATH):
        plain, made = encoder.plain, encoder.plain.word
        plain.word = lambda word, made=made: (encoded.append(word), made(word))[1]
        monkeypatch.setattr(bpe.Merges, "words", None)
        list(encoder.ids("Gnarl, gnarl. (gnarl) GNARL! gnarl? gnarl; gnarl"))
        assert encoded.count(b"gnarl") == 1
        encoded.clear()
