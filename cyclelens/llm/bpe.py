"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

A merge list fixes how far to the right the fate of a boundary between two symbols can depend on the text. With that many symbols read
beyond it, a token is stable and is emitted; what is kept is one block and the lookahead, however long the text or the word.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cyclelens.llm.common import mapped, table

#: Symbols that a transducer takes before it emits what is stable; characters of a text that are split into words at once.
BLOCK, STRETCH = 512, 1 << 16
#: Characters of a run without white space that are taken at once, where the run is longer than two stretches.
SEGMENT = 1 << 14
#: Runs and words whose ids a task remembers, twice as many of each at most. Runs are only remembered where characters are not all familiar.
REMEMBERED, WORDS = 100_000, 200_000
#: Longest word that is remembered; a longer one goes through the transducer each time.
SHORT = 64
#: Code points below are taken apart here.
FAMILIAR = 0x250


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of a tokenizer file, as ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.suffix] for c in letters]
        #: Rank of each pair that merges, and what each rank makes.
        self.pairs: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), len(self.made))
            self.made.append(self.vocab[a + b])
        self.lookahead = self._lookahead()
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.mark = os.path.commonprefix(list(self.special))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # For characters below FAMILIAR, whose classes no Unicode version changes, the classes are written out for the faster engine.
        for name in "LN":
            chosen = "".join(re.escape(chr(c)) for c in range(FAMILIAR) if unicodedata.category(chr(c))[0] == name)
            pattern = pattern.replace(rf"\p{{{name}}}", chosen)
        self.pieces = re.compile(pattern.replace("[[", "[").replace("]]", "]").replace(r"\s", r"\t-\r \x85\xa0"))
        # Beyond, the library's own normaliser and splitter say what a word is; the merging is done here all the same.
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.letters = {c: b for b, c in enumerate(letters)}

    def _lookahead(self) -> int:
        """Symbols to the right of a boundary that suffice to tell whether any merge ever crosses it.

        A rule (u, v) crosses if v stands there, which takes the symbols of v and that no earlier rule took v's end away: a rule whose
        left side is v or lies on the right edge of v's own merges. Rules are met in order of rank, so each needs only earlier ones.
        """
        length = dict.fromkeys([*self.inner, *self.final], 1)
        right: dict[int, int] = {}
        reach: dict[int, int] = {}
        most = 1
        for (u, v), rank in self.pairs.items():
            made, need, edge = self.made[rank], 0, v
            while edge is not None:
                need = max(need, reach.get(edge, 0))
                edge = right.get(edge)
            need += length[v]
            reach[u] = max(reach.get(u, 0), need)
            most = max(most, need)
            if made not in length:
                length[made] = length[u] + length[v]
                right[made] = v
        return most

    def words(self, run: str) -> Iterator[bytes]:
        """The words of a run without white space, as the bytes that are encoded."""
        plain = normal(run)
        if plain.isascii() or max(plain) < chr(FAMILIAR):
            for word in self.pieces.findall(plain):
                yield word.encode()
        else:
            for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(run)):
                yield bytes(map(self.letters.__getitem__, word))

    def one_word(self, before: str, after: str) -> bool:
        """Whether two neighbouring characters, of which neither is an apostrophe, lie in one word."""
        return len(self.splitter.pre_tokenize_str(before + after)) == 1

    def edges(self, run: str) -> tuple[str, str]:
        """The first and the last character of a run once it is normalised."""
        plain = normal(run)
        if not plain.isascii() and max(plain) >= chr(FAMILIAR):
            plain = self.normalizer.normalize_str(run)
        return plain[:1], plain[-1:]

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges applied in order of rank, the leftmost first."""
        if len(symbols) > 64:
            return self._merged_long(symbols)
        get, none = self.pairs.get, len(self.made)
        ranks = list(map(get, zip(symbols, symbols[1:]), repeat(none)))
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            k = ranks.index(rank)
            symbols[k] = made = self.made[rank]
            del symbols[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get((symbols[k - 1], made), none)
            if k < len(ranks):
                ranks[k] = get((made, symbols[k + 1]), none)
        return symbols

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap, for time in proportion to the length but for a logarithm."""
        get, n = self.pairs.get, len(symbols)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k, *pair) for k, pair in enumerate(zip(symbols, symbols[1:])) if (rank := get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            after = following[k]
            if symbols[k] != a or after >= n or symbols[after] != b:
                continue
            symbols[k], symbols[after] = self.made[rank], -1
            following[k] = after = following[after]
            if after < n:
                before[after] = k
            for left, right in ((before[k], k), (k, after)):
                if left >= 0 and right < n and (rank := get((symbols[left], symbols[right]))) is not None:
                    heapq.heappush(heap, (rank, left, symbols[left], symbols[right]))
        return [s for s in symbols if s >= 0]


class Transducer:
    """Ids of one word whose symbols come in parts."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block = merges, block
        self.symbols: list[int] = []
        self.width = {i: max(1, len(t.removesuffix(merges.suffix) if merges.suffix else t)) for i, t in merges.tokens.items()} if block else {}

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        """Takes symbols of which more follow, and emits the tokens that end at least the lookahead before the last of them."""
        self.symbols.extend(symbols)
        m = self.merges
        while len(self.symbols) >= self.block + m.lookahead:
            part = self.symbols[: self.block + m.lookahead]
            end = 0
            for token in m.merged(list(part)):
                if end + self.width[token] > len(part) - m.lookahead:
                    break
                end += self.width[token]
                yield token
            if not end:  # a token as wide as a block: take more
                self.block *= 2
            del self.symbols[:end]

    def finish(self) -> list[int]:
        """The rest, which ends the word."""
        rest, self.symbols = self.symbols, []
        return self.merges.merged(rest)


class Remembered(dict):
    """A table of at most about 2 * LIMIT entries: when it is full, all but what was used since the last time goes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Encoder(Remembered):
    """Ids of a run of characters without white space, as little-endian unsigned 32-bit integers; remembers short runs."""

    def __init__(self, merges: Merges):
        super().__init__(REMEMBERED)
        self.merges = merges
        self.known = Remembered(WORDS)
        self.plain = Plain(self)
        self.transducer = Transducer(merges)

    def familiar(self, part: str) -> list[str] | None:
        """The words of a stretch that needs neither the library's splitter nor its special tokens, which only ask for white space to be no word."""
        m = self.merges
        if m.special and m.mark in part:
            return None
        plain = normal(part)
        return m.pieces.findall(plain) if plain.isascii() or max(plain) < chr(FAMILIAR) else None

    def __missing__(self, run: str) -> bytes:
        out = self.old.get(run)
        if out is None:
            m, parts = self.merges, []
            for part in m.split.split(run) if m.special and m.mark in run else (run,):
                if part in m.special:
                    parts.append(struct.pack("<I", m.special[part]))
                elif part:
                    for word in m.words(part):
                        parts.append(self.known.get(word) or self.word(word))
            out = b"".join(parts)
        if len(run) <= SHORT:
            self.keep(run, out)
        return out

    def part(self, part: bytes, last: bool) -> bytes:
        """Ids that are certain once this part of a word is read. The last byte of a word is another symbol than the same byte within it."""
        m, ids = self.merges, []
        inner = part[:-1] if last else part
        for k in range(0, len(inner), BLOCK):
            ids.extend(self.transducer.feed(map(m.inner.__getitem__, inner[k : k + BLOCK])))
        if last:
            self.transducer.symbols.append(m.final[part[-1]])
            ids.extend(self.transducer.finish())
        return struct.pack(f"<{len(ids)}I", *ids)

    def segments(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Ids of the run that text[at:end] is, a segment at a time; a word that goes on over a cut is one word to the transducer."""
        m = self.merges
        held, begun, before = b"", False, ""
        while at < end:
            cut = _cut_after(text, at, end)
            run = text[at:cut]
            words = list(m.words(run))
            first, last = m.edges(run)
            if held:
                goes_on = m.one_word(before, first)
                if goes_on or begun:
                    yield self.part(held, not goes_on)
                else:
                    yield self.known.get(held) or self.word(held)
                begun = goes_on
                if begun and len(words) > 1:
                    yield self.part(words.pop(0), True)
                    begun = False
            for word in words[:-1]:
                yield self.known.get(word) or self.word(word)
            held, before, at = words[-1], last, cut
        if held:
            yield self.part(held, True) if begun else self.known.get(held) or self.word(held)

    def long(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Ids of a run of any length; special tokens part it."""
        m = self.merges
        for found in m.split.finditer(text, at, end) if m.split else ():
            yield from self.segments(text, at, found.start())
            yield struct.pack("<I", m.special[found.group()])
            at = found.end()
        yield from self.segments(text, at, end)

    def ids(self, text: str, stretch: int | None = None) -> Iterator[bytes]:
        """Ids of a text as they become certain."""
        unlike = _UNLIKE.search(text) is not None
        for part in stretches(text, stretch or STRETCH):
            if isinstance(part, tuple):
                yield from self.long(text, *part)
            elif (words := self.familiar(part)) is not None:
                yield b"".join(map(self.plain.__getitem__, words))
            else:
                yield b"".join(map(self.__getitem__, _parted(part, unlike)))

    def word(self, word: bytes) -> bytes:
        out = self.known.old.get(word)
        if out is None:
            out = self.encoded(word)
        if len(word) <= SHORT:
            self.known.keep(word, out)
        return out

    def encoded(self, word: bytes) -> bytes:
        """Ids of a whole word."""
        if len(word) > SHORT:
            self.transducer.symbols = []
            return self.part(word, True)
        m = self.merges
        ids = m.merged([*map(m.inner.__getitem__, word[:-1]), m.final[word[-1]]])
        return struct.pack(f"<{len(ids)}I", *ids)


class Plain(Remembered):
    """Ids of a word of familiar characters; remembers short words."""

    def __init__(self, encoder: Encoder):
        super().__init__(WORDS)
        self.word = encoder.encoded

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.word(word.encode())
        if len(word) <= SHORT:
            self.keep(word, out)
        return out


def normal(text: str) -> str:
    """NFC, then every character's own lower case (no special form of a sigma that ends a word)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_UNLIKE = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


_LAST_SPACE = regex.compile("(?r)" + _SPACES.pattern)


def _alone(c: str) -> bool:
    """Whether normalising never joins the character to what is before it: no mark, no part of a Korean syllable, nothing unassigned."""
    return unicodedata.category(c)[0] in "LNPS" and not unicodedata.combining(c) and not ("\u1100" <= c <= "\u11ff" or "\ua960" <= c <= "\ua97f" or "\ud7b0" <= c <= "\ud7ff")


def _cut_after(text: str, at: int, end: int) -> int:
    """Where a segment that begins at `at` may end, so that normalising and splitting each side gives the same words but for one that goes on.

    An apostrophe may make a word with up to two characters that follow it, so none lies near a cut.
    """
    cut = at + SEGMENT
    while cut < end and not (_alone(text[cut]) and "'" not in text[cut - 3 : cut + 1]):
        cut += 1
    return min(cut, end)


def stretches(text: str, stretch: int = STRETCH) -> Iterator[str | tuple[int, int]]:
    """The text in parts that end at white space; of a run without any of more than two stretches its place alone."""
    at = 0
    while at < len(text):
        end = min(at + stretch, len(text))
        if end < len(text):
            space = _SPACES.search(text, end, end + stretch)
            if space is None and end + stretch < len(text):
                space = _LAST_SPACE.search(text, at, end)
                if space is None:
                    space = _SPACES.search(text, end)
                    end = space.start() if space else len(text)
                    yield at, end
                    at = end
                    continue
            end = space.end() if space else len(text)
        yield text[at:end]
        at = end


def _parted(part: str, unlike: bool) -> list[str]:
    """The runs of other than white space. str.split takes four control characters for white space that the tokenizers take for characters."""
    return [r for r in _SPACES.split(part) if r] if unlike else part.split()


class Decoder:
    """Text of ids that come in parts: bytes go through an incremental UTF-8 decoder, so that nothing is emitted before it is whole.

    A vocabulary without a decoder gives its tokens as written, parted by spaces; `raw` gives the bytes that byte-level tokens stand for.
    """

    def __init__(self, merges: Merges, raw: bool = False):
        if raw:
            back = {c: b for b, c in enumerate(byte_letters())}
            self.bytes = {i: bytes(back[c] for c in t) if t not in merges.special else t.encode() for i, t in merges.tokens.items()}
        else:
            self.bytes = {i: t.encode() for i, t in merges.tokens.items()}
        self.between = b"" if raw else b" "
        self.reset()

    def reset(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        data = self.between.join(map(self.bytes.__getitem__, ids))
        if data and self.begun:
            data = self.between + data
        self.begun = self.begun or bool(data)
        return self.state.decode(data)

    def finish(self) -> str:
        rest = self.state.decode(b"", True)
        self.reset()
        return rest


_LOADED: dict[str, tuple[Encoder, Decoder]] = {}


def loaded(path: str) -> tuple[Encoder, Decoder]:
    if path not in _LOADED:
        merges = Merges(path)
        _LOADED[path] = Encoder(merges), Decoder(merges)
    return _LOADED[path]


def digest(text: str, encoder: Encoder, decoder: Decoder) -> tuple[int, str, str]:
    """Number of ids, and SHA-256 of the ids and of the decoded text; of either, two stretches or a segment of a long run are held.

    Only a run of combining marks is held whole, as their order is not certain before its end.
    """
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
    decoder.reset()
    for data in encoder.ids(text):
        n += len(data) // 4
        of_ids.update(data)
        of_text.update(decoder.feed(memoryview(data).cast("I")).encode())
    of_text.update(decoder.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 of the text encoded and decoded again.

    A null text is an empty one, which has no ids; a very long one is read in parts, also where it has no white space. The file at `path` is read on the executors, where it must lie as on the driver.
    Rows that repeat get a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = loaded(path)
        for batch in batches:
            found = [digest(t.as_py() or "", encoder, decoder) for t in batch.column(1)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
