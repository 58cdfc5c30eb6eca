"""Language identification by mixture inference.

Each language has a model of hashed byte trigrams. A document is a mixture of languages: expectation-maximisation finds the proportions that
make its trigrams likeliest, and languages are added to its set as long as the likelihood gains more than a penalty for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens.llm.common import mapped, sized, table, written
from cyclelens.llm.words import slices, utf8

BUCKETS = 1 << 15
#: Documents that a language's model is fitted on, about, where more are labelled.
LABELLED = 10_000
#: Rounds of expectation-maximisation, and the change of all proportions below which they end.
ROUNDS, STILL = 50, 1e-4
#: Log-likelihood that a further language must gain, in halves of the logarithm of the number of trigrams.
PENALTY = 2.0
#: What is predicted for a text without a letter.
UNKNOWN = "und"

_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_LETTER = regex.compile(r"\p{L}")


def trigrams(column: pa.Array) -> Iterator[np.ndarray]:
    """The buckets of each text's byte trigrams: ASCII letters lower-cased, other ASCII as spaces, none with two spaces side by side."""
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        part = _PLAIN[data[offsets[first] : offsets[last]]]
        if len(part) < 3:
            yield from (np.zeros(0, np.int64) for _ in range(first, last))
            continue
        a, b, c = part[:-2], part[1:-1], part[2:]
        gram = (a.astype(np.uint32) << np.uint32(16)) | (b.astype(np.uint32) << np.uint32(8)) | c
        bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
        solid = (b != 32) | ((a != 32) & (c != 32))
        for k in range(first, last):
            begin, end = offsets[k] - offsets[first], offsets[k + 1] - offsets[first] - 2
            yield bucket[begin:end][solid[begin:end]] if end > begin else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, bucket in zip(batch.column(0).to_pylist(), trigrams(batch.column(1)), strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, np.int64)
            counts[lang] += np.bincount(bucket, minlength=BUCKETS)
    for lang, n in counts.items():
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(n[seen])], names=["lang", "bucket", "n"])


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages in order, and the probability of each bucket in each; what reaches the driver are BUCKETS numbers a language.

    Learns from labelled documents that are not held out, LABELLED a language or so, chosen by a hash of the id.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    counts = written(usable.groupBy(F.col(lang_col).alias("of_lang")).agg(F.count("*").alias("of_n")), "language-counts")
    chosen = usable.join(sized(counts), usable[lang_col] == counts["of_lang"])
    chosen = chosen.where(F.pmod(F.xxhash64(F.lit(4), F.col(id_col)), F.col("of_n")) < LABELLED).select(F.col("of_lang").alias("lang"), F.col(text_col).alias("text"))
    found = mapped(chosen, _count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    n = np.zeros((len(langs), BUCKETS))
    if langs:
        n[np.searchsorted(np.array(langs, dtype=object), np.array(found.column("lang").to_pylist(), dtype=object)), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    n += 0.5
    return langs, n / n.sum(axis=1, keepdims=True)


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the rows of p (probabilities of each trigram) that make n occurrences likeliest, and the log-likelihood."""
    share, total = np.full(len(p), 1 / len(p)), n.sum()
    if len(p) > 1:
        for _ in range(ROUNDS):
            new = share * (p @ (n / (share @ p))) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < STILL:
                break
    return share, float(n @ np.log(share @ p))


def languages_of(model: np.ndarray, bucket: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The set of languages of one document and their proportions."""
    n = np.bincount(bucket, minlength=BUCKETS)
    seen = np.flatnonzero(n)
    n = n[seen].astype(float)
    p = model[:, seen]
    share, _ = mixture(p, n)
    # The likeliest language alone comes first; then the others by their proportion, while each gains more than it costs.
    alone = np.log(p) @ n
    best = int(np.argmax(alone))
    order = [best, *(int(k) for k in np.argsort(-share, kind="stable") if k != best)]
    chosen, shares, value = [best], np.ones(1), float(alone[best])
    cost = PENALTY * 0.5 * np.log(n.sum())
    for k in range(2, len(order) + 1):
        more, gained = mixture(p[order[:k]], n)
        if gained - cost <= value:
            break
        chosen, shares, value = order[:k], more, gained
    return chosen, shares


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, languages.

    lang_pred is the language of the largest proportion, score that proportion, languages the set with proportions ("en:0.75,fr:0.25").
    A text that is null or has no letter is `und` with score 0, as is every text if no language could be learned; one with letters but no
    trigram gets the languages' average, the first by name. A null id is not held out. Rows that repeat get equal answers. Other columns
    are not read, and the label only of documents that are learned from.
    """
    langs, model = fitted(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores, sets = [], [], []
            for text, bucket in zip(batch.column(1), trigrams(batch.column(1)), strict=True):
                if not langs or not _LETTER.search(text.as_py() or ""):
                    preds.append(UNKNOWN), scores.append(0.0), sets.append("")
                    continue
                chosen, shares = languages_of(model, bucket) if len(bucket) else (list(range(len(langs))), np.full(len(langs), 1 / len(langs)))
                top = int(np.argmax(shares))
                preds.append(langs[chosen[top]])
                scores.append(min(1.0, float(shares[top])))
                sets.append(",".join(f"{langs[k]}:{s:.3f}" for k, s in zip(chosen, shares, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return mapped(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
