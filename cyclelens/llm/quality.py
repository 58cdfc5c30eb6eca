"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample of their ratio.

Each text is a bag of hashed features: its runs of letters and of other signs, and pairs of neighbouring runs (a run that repeats its
forerunner is a feature of its own). The target model counts them in documents labelled good, the raw model in all documents. A
document's weight is the ratio of its probabilities; noise from a Gumbel distribution added to the logarithm makes the k largest a sample
without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens.llm.common import mapped, table, text_key, without, written
from cyclelens.llm.words import mixed, slices, token_hashes, utf8

#: Features are hashed to so many buckets; the models are two numbers for each.
BUCKETS = 1 << 16
#: Documents labelled good from which the target model is fitted, about, where more are labelled.
LABELLED = 50_000
SEED = 17
_SAME = np.uint64(1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts (first, last): the bucket of each feature and the text it belongs to, counted from first."""
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        h, text = token_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1])
        near = text[1:] == text[:-1]
        pair = np.where(h[1:] == h[:-1], _SAME, mixed(h[:-1] * _PAIR + h[1:]))[near]
        bucket = (np.concatenate([h, pair]) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
        bucket[len(h) :][pair == _SAME] = 0
        yield first, last, bucket, np.concatenate([text, text[1:][near]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for first, _, bucket, text in features(batch.column(0)):
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[first + text]], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of the target to the raw probability of each bucket.

    Raw counts cover every document. The target model is fitted on documents whose labels all say good, LABELLED of them or so. It falls
    back on the raw model with the weight of BUCKETS features, so that what it has seen little of counts neither way.
    """
    rated = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = written(rated.where("quality = 1").select(F.col("doc_id").alias("__good_id")), "quality-good")
    n = good.count()
    if n > LABELLED:
        good = good.where(F.pmod(F.xxhash64(F.lit(SEED), "__good_id"), F.lit(n)) < LABELLED)
    marked = docs.join(F.broadcast(good), docs[id_col] == good["__good_id"], "left").select(
        F.col(text_col).alias("text"), F.col("__good_id").isNotNull().alias("good")
    )
    counted = mapped(marked, _count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted.toLocalIterator():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + BUCKETS * p_raw) / (target.sum() + BUCKETS)) - np.log(p_raw)


def weighted(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_features, log_weight) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, last, bucket, text in features(batch.column(1)):
                n[first:last] = np.bincount(text, minlength=last - first)
                weight[first:last] = np.bincount(text, ratio[bucket], last - first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(weight)], names=["doc_id", "text_key", "n_features", "log_weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key"))
    return mapped(rows, run, "doc_id long, text_key long, n_features long, log_weight double")


#: A document is rejected for being likelier as raw text than as target text by this factor, up to the sampling noise.
ODDS = 30_000.0
#: So is one whose features are likelier as raw text by this mean logarithm, since a short text cannot gather the odds. Chosen from labelled
#: rows of sf0.1: of documents labelled good the lowest mean is -0.15, and -0.17 among those that the model was not fitted on.
LEAST_MEAN = -0.25
#: Scores are ranked in steps of 2**-20; equal ones by a hash of the id.
_STEPS = float(1 << 20)
_BINS = 1 << 12


def kth_largest(rows: DataFrame, col: str, k: int) -> tuple[int, int]:
    """The k-th largest value of a long column (k from 1 to its number of rows), and how many rows are larger. Values span under 2**63.

    The range is narrowed by histograms of at most 4,097 bins, so that only these reach the driver.
    """
    low, high = rows.agg(F.min(col), F.max(col)).first()
    above = 0
    while low < high:
        width = (high - low) // _BINS + 1
        inside = rows.where(F.col(col).between(low, high))
        bins = inside.groupBy(F.expr(f"({col} - ({low}L)) div {width}L").alias("bin")).count().collect()
        for b, n in sorted(((r["bin"], r["count"]) for r in bins), reverse=True):
            if above + n >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            above += n
    return low, above


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", odds: float = ODDS, k: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_features, log_weight, score (with the noise), kept.

    The k rows with the largest scores are kept; without k, of those whose mean log ratio by feature is LEAST_MEAN or more, as many as are
    at most `odds` times likelier under the raw than under the target model. Noise and ties come from hashes of the id, so a rerun gives the same sample; rows that repeat an id and a text stand or
    fall together, also where that makes more than k. A null or empty text weighs 0. With no document labelled good every weight is 0.
    The result has no rows for an empty table; other columns are not read.
    """
    return _sampled(docs, labels, id_col, text_col, odds, k).drop("text_key")


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, odds: float = ODDS, k: int | None = None) -> DataFrame:
    """The rows of resampled with the text_key of each."""
    scored = weighted(docs, fitted(docs, labels, id_col, text_col), id_col, text_col)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    scored = scored.withColumn("score", F.col("log_weight") - F.log(-F.log(uniform)))
    scored = scored.withColumn("rank_key", F.floor(F.col("score") * _STEPS)).withColumn("tie_key", F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), "doc_id"), 1))
    scored = written(scored, "quality-scores")
    fit = F.col("log_weight") >= F.col("n_features") * LEAST_MEAN if k is None else F.lit(True)
    total, likely = scored.where(fit).agg(F.count("*"), F.count_if(F.col("log_weight") > -float(np.log(odds)))).first()
    k = min(total, likely if k is None else k)
    if k == 0:
        kept = F.lit(False)
    else:
        least, above = kth_largest(scored.where(fit), "rank_key", k)
        tie, _ = kth_largest(scored.where(fit & (F.col("rank_key") == least)), "tie_key", k - above)
        kept = fit & ((F.col("rank_key") > least) | ((F.col("rank_key") == least) & (F.col("tie_key") >= tie)))
    return scored.select("doc_id", "text_key", "n_features", "log_weight", "score", kept.alias("kept"))


def good_ones(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that the sample leaves out; all columns as they are. Rows with a null id stay; of rows that share an id only those
    with the same text go together."""
    dropped = written(_sampled(docs, labels, id_col, text_col).where("not kept and doc_id is not null").select("doc_id", "text_key").distinct(), "quality-dropped")
    return without(docs, dropped, id_col, text_col)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
