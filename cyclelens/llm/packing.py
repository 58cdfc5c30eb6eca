"""Hierarchical multi-length packing of documents into training sequences.

A document's tokens are cut into whole windows and a remainder. The remainder is routed to the smallest context tier that holds it.
Windows are opened by the longest remainders, tier by tier, and their gaps are filled from the same and the shorter tiers, each time by
the longest that fits. As only lengths matter, this is decided on the histogram of lengths (at most WINDOW rows, whatever the input) as
a list of window patterns; which piece takes which place is then arithmetic on its rank among pieces of its length. Where lengths leave
windows with wide gaps, as a third of all documents having one length may, the remainders in them are cut at the tiers and packed once
more. Windows are dealt to step groups by falling attention cost, to and fro, so that the groups cost about the same.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cyclelens.llm.bpe import SHORT, Encoder, Merges, byte_letters
from cyclelens.llm.common import mapped, small_batches, table, written

WINDOW, TIERS = 4096, (512, 1024, 2048, 4096)
#: The id that ends each document.
END = 2
#: Sequences of one optimiser step.
STEP = 64
#: Pieces of one length that are ranked together.
RANKED = 50_000
#: Least share of a window that must be filled for its remainders to stay whole.
FULL = 0.98


def parts_of(length: int) -> list[int]:
    """The lengths that a remainder is cut into at the tiers: powers of two, and what is shorter than the shortest tier."""
    out = []
    for tier in (*TIERS[-2::-1], 1):
        n = length // tier * tier if tier == 1 else length // tier and tier
        out += [n] if n else []
        length -= n
    return out


class LibraryEncoder(Encoder):
    """Ids as the library's own model gives them for each short word; only a long word goes through the transducer, which need not hold it."""

    def __init__(self, path: str):
        super().__init__(Merges(path))
        self.model = Tokenizer.from_file(path).model
        self.letter = dict(enumerate(byte_letters()))
        self.of_id = {i: i.to_bytes(4, "little") for i in self.merges.tokens}

    def encoded(self, word: bytes) -> bytes:
        if len(word) > SHORT:
            return super().encoded(word)
        return b"".join([self.of_id[token.id] for token in self.model.tokenize(word.decode("latin-1").translate(self.letter))])


_LOADED: dict[str, LibraryEncoder] = {}


def loaded(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def _cut(text: str, encoder) -> tuple[list[tuple[int, int, int, list[int]]], int]:
    """(start, length, CRC-32 of the ids, CRC-32 of each part) of each piece, and the document's ids; a stretch and a window are held."""
    pieces, held, start = [], b"", 0
    size = 4 * WINDOW

    def take(data: bytes, last: bool) -> bytes:
        nonlocal start
        at = 0
        while len(data) - at >= size or last and at < len(data):
            part = data[at : at + size]
            pieces.append((start, len(part) // 4, zlib.crc32(part), _crcs(part)))
            start += len(part) // 4
            at += len(part)
        return data[at:]

    for data in encoder.ids(text):
        held = take(held + data, False)
    take(held + END.to_bytes(4, "little"), True)
    return pieces, start


def _crcs(data: bytes) -> list[int]:
    out, at = [], 0
    for n in parts_of(len(data) // 4) if len(data) < 4 * WINDOW else ():
        out.append(zlib.crc32(data[at : at + 4 * n]))
        at += 4 * n
    return out


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's whole windows and remainder, the remainder with the CRCs of its parts, and a number for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for k, text in enumerate(batch.column(1)):
                pieces, total = _cut(text.as_py() or "", encoder)
                for piece in pieces:
                    for column, value in zip(rows, (k, *piece, total), strict=True):
                        column.append(value)
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            made = [pa.array(c, pa.list_(pa.int64()) if k == 3 else pa.int64()) for k, c in enumerate(rows[1:])]
            yield pa.RecordBatch.from_arrays([ids, *made], names=["doc_id", "start", "length", "ids_crc32", "part_crcs", "doc_tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = mapped(source, run, "doc_id long, start long, length long, ids_crc32 long, part_crcs array<long>, doc_tokens long")
    with small_batches(docs.sparkSession):
        return written(cut.withColumn("piece", F.monotonically_increasing_id()), "packing-pieces")


def plan(histogram: dict[int, int], full: float = 0.0) -> tuple[np.ndarray, int, dict[int, int]]:
    """Allotments (length, first rank, pieces a window, first sequence, offset, cost of the window), the sequences, and the pieces placed.

    An allotment gives consecutive ranks of one length their places in the windows of one pattern. At least one length runs out with each
    pattern, or falls below what a window of the pattern takes, so patterns are few. Windows filled to less than `full` are left out.
    """
    left, used = dict(histogram), dict.fromkeys(histogram, 0)
    lengths = sorted(left)
    rows, sequence = [], 0
    while lengths:
        room, top, pattern = WINDOW, len(lengths) - 1, []
        while top >= 0:
            length = lengths[top]
            n = min(left[length], room // length)
            pattern.append((length, n))
            room -= n * length
            top = min(top - 1, bisect_right(lengths, room) - 1)
        windows = min(left[length] // n for length, n in pattern)
        good, offset, cost = WINDOW - room >= full * WINDOW, 0, sum(n * length * length for length, n in pattern)
        for length, n in pattern:
            left[length] -= n * windows
            if not left[length]:
                lengths.remove(length)
            if good:
                rows.append((length, used[length], n, sequence, offset, cost))
                used[length] += n * windows
                offset += n * length
        sequence += windows if good else 0
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6), sequence, used


PARTED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long"


def _parted(batches: Iterator[pa.RecordBatch], placed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pieces not placed as a whole, cut into their parts; a whole window is one part."""
    for batch in batches:
        rows = []
        late = batch.column("rank").to_numpy() >= placed[batch.column("length").to_numpy()]
        for r in batch.filter(pa.array(late)).to_pylist():
            start = r["start"]
            parts = zip(parts_of(r["length"]), r["part_crcs"], strict=True) if r["part_crcs"] else [(r["length"], r["ids_crc32"])]
            for n, crc in parts:
                rows.append({"doc_id": r["doc_id"], "start": start, "length": n, "ids_crc32": crc, "doc_tokens": r["doc_tokens"], "piece": r["piece"]})
                start += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.int64()) for n in names]))


def _histogram(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with their rank among those of one length, and how many there are of each (at most WINDOW rows)."""
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("piece", "start"), F.lit(pieces.count() // RANKED + 1)))
    counts = written(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "packing-counts")
    found = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("of_length"), F.col("salt").alias("of_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = written(bases, "packing-bases")
    ranked = pieces.withColumn("nth", F.row_number().over(W.partitionBy("length", "salt").orderBy("piece", "start")))
    ranked = ranked.join(bases, (ranked["length"] == bases["of_length"]) & (ranked["salt"] == bases["of_salt"]))
    return ranked.drop("of_length", "of_salt", "salt").withColumn("rank", (F.col("base") + F.col("nth") - 1).cast("long")), found


def _placed(allotments: np.ndarray, places: np.ndarray, sequences: int, placed: np.ndarray):
    """The pieces that have a place as a whole, with it."""
    steps = max(1, -(-sequences // STEP))
    width = np.int64(1) << np.int64(48)
    starts = allotments[:, 0] * width + allotments[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            early = batch.column("rank").to_numpy() < placed[batch.column("length").to_numpy()]
            batch = batch.filter(pa.array(early))
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, length * width + rank, "right") - 1
            _, first, n, sequence, offset, _ = allotments[at].T
            window, slot = np.divmod(rank - first, n)
            lap, step = np.divmod(places[at] + window, steps)
            step = np.where(lap % 2, steps - 1 - step, step)
            tier = np.array(TIERS)[np.searchsorted(TIERS, length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            made = [pa.array(sequence + window), pa.array(offset + slot * length), pa.array(tier), pa.array(step)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "sequence_id", "offset", "tier", "step_group"])

    return run


def _cost_places(plans: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """For each allotment, the place of its pattern's first window when all windows are ordered by falling cost."""
    windows: dict[int, tuple[int, int]] = {}
    for rows, sequences in plans:
        starts = sorted({(int(s), int(c)) for s, c in zip(rows[:, 3], rows[:, 5], strict=True)})
        for (start, cost), after in zip(starts, [*(s for s, _ in starts[1:]), sequences], strict=False):
            windows[start] = (cost, after - start)
    place, total = {}, 0
    for start in sorted(windows, key=lambda s: (-windows[s][0], s)):
        place[start], total = total, total + windows[start][1]
    return [np.array([place[int(s)] for s in rows[:, 3]], dtype=np.int64) for rows, _ in plans]


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document is its ids by the tokenizer file at `path` and the id that ends it; a null or empty text is that id alone. Every id lies in
    one piece of at most WINDOW, pieces lie in sequences without gaps from offset 0, and sequence ids count from 0. Rows that repeat, or
    have a null id, are documents of their own. An empty table gives no rows; other columns are not read.
    """
    ranked, histogram = _histogram(pieces_of(docs, path, id_col, text_col))
    ranked = written(ranked, "packing-ranked")
    whole, first, used = plan(histogram, FULL)
    placed = _by_length(used)
    more, histogram = _histogram(written(mapped(ranked, lambda batches: _parted(batches, placed), PARTED), "packing-parts"))
    cut, second, used = plan(histogram)
    cut[:, 3] += first
    places = _cost_places([(whole, first), (cut, first + second)])
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]
    early = mapped(ranked.select(columns), _placed(whole, places[0], first + second, placed), schema)
    return early.union(mapped(more.select(columns), _placed(cut, places[1], first + second, _by_length(used)), schema))


def _by_length(used: dict[int, int]) -> np.ndarray:
    out = np.zeros(WINDOW + 1, dtype=np.int64)
    for length, n in used.items():
        out[length] = n
    return out


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
