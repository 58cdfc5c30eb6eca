"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt to blocks of bounded size. Each block sorts its rows by every dimension once; a query walks the lists from the end that
its component favours, scores what it meets, and stops when no row that it has not met can reach its k-th best score. The best of
each block are merged by query. Blocks of vectors meet blocks of queries, so neither side is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclelens.llm.common import mapped, table, written

K, SCALE, EVERY = 5, 256, 50
#: Vectors and queries in a block, about.
VECTORS, QUERIES = 16_384, 4_096
#: Rows of each list that are read first; each further step reads as many as all before.
FIRST = 8


def integers(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Leaves out rows without id or vector, or with a null or non-finite component.

    An id is one vector: of rows that repeat it, the smallest vector stands.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    usable = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.forall("x", finite))
    return usable.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


class Lists:
    """A block of vectors with its rows sorted by each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids)
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.falling = np.argsort(-self.vectors, axis=0, kind="stable").T  # a row of row numbers for each dimension
        # Sums of products are exact in doubles below 2**53; beyond, integers are used.
        self.largest = float(np.abs(self.vectors).max(initial=0)) if self.vectors.size else 0.0
        self.floats = self.vectors.astype(float)
        self.squares = np.einsum("ij,ij->i", self.floats, self.floats)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than the query's own: higher scores first, then smaller ids."""
        n, dims = self.vectors.shape
        exact = dims * self.largest * float(np.abs(query).max(initial=0)) < 2**53
        data, q = (self.floats, query.astype(float)) if exact else (self.vectors, query)
        up = query >= 0
        met = np.zeros(n, dtype=bool)
        best, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        depth, step = 0, FIRST
        while depth < n:
            to = min(depth + step, n)
            seen = met.copy()
            seen[self.falling[up, depth:to].ravel()] = True
            seen[self.falling[~up, n - to : n - depth].ravel()] = True
            new = np.flatnonzero(seen & ~met)
            met, depth, step = seen, to, to
            new = new[self.ids[new] != query_id]
            rows = np.concatenate([best, new])
            scores = np.concatenate([scores, data[new] @ q])
            order = np.lexsort((rows, -scores))[:k]  # rows are in order of id
            best, scores = rows[order], scores[order]
            if met.all():
                break
            # The most that a row not met can score: in each list it lies beyond the last row read.
            last = np.where(up, self.falling[:, to - 1], self.falling[:, n - to])
            edge = data[last, np.arange(dims)]
            if len(best) == k and (edge @ q < scores[-1] or _most(edge, q, self.squares[~met].max()) < scores[-1]):
                break
        return self.ids[best], scores.astype(np.int64)


#: Multipliers that the bound by length tries, in units of the query's length over the rows' greatest.
_TRIED = np.geomspace(1 / 16, 16, 33)


def _most(edge: np.ndarray, query: np.ndarray, square: float) -> float:
    """No row scores more whose components lie beyond `edge` in the direction of the query and whose squared length is `square` at most.

    For any m > 0 the product a*y is at most the greatest a*y - m/2 * (y*y - square) over all y that are not beyond the edge, which each
    component reaches at a/m or at the edge. The least over some m is taken, and a little more for rounding.
    """
    a, y = np.abs(query).astype(float), np.where(query >= 0, edge, -edge).astype(float)
    length = float(np.sqrt(a @ a))
    if not length or not square > 0:
        return float("inf")
    m = _TRIED[:, None] * (length / np.sqrt(square))
    y = np.minimum(y, a / m)
    bounds = y @ a - m[:, 0] / 2 * (np.einsum("ij,ij->i", y, y) - square)
    return float(bounds.min() + 1e-9 * (length * np.sqrt(square) + 1))


def _stacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled with zeros."""
    out = np.zeros((len(column), width), dtype=np.int64)
    for k, v in enumerate(column):
        v = v.values.to_numpy(zero_copy_only=False)
        out[k, : len(v)] = v
    return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (vector block, query block, is_query, vec_id, v), one pair of blocks after another."""
        lists, held, rest = None, None, []

        def answered(rows: pa.Table) -> pa.RecordBatch:
            nonlocal lists, held
            is_query = rows.column("is_query").to_numpy()
            width = max((len(v) for v in rows.column("v")), default=0)
            ids, vectors = rows.column("vec_id").to_numpy(), _stacked(rows.column("v"), width)
            lists = Lists(ids[~is_query], vectors[~is_query])
            out: tuple[list, list, list] = ([], [], [])
            for q in np.flatnonzero(is_query):
                found, scores = lists.top(ids[q], vectors[q], k)
                out[0].append(np.full(len(found), ids[q]))
                out[1].append(found)
                out[2].append(scores)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["query_id", "vec_id", "score"]
            )

        for batch in batches:
            at = 0
            pair = batch.column("pair").to_numpy()
            cuts = [*(np.flatnonzero(pair[1:] != pair[:-1]) + 1), batch.num_rows]
            for cut in cuts:
                if cut == at:
                    continue
                if rest and held != pair[at]:
                    yield answered(pa.Table.from_batches(rest).combine_chunks())
                    rest = []
                held = pair[at]
                rest.append(batch.slice(at, cut - at))
                at = cut
        if rest:
            yield answered(pa.Table.from_batches(rest).combine_chunks())

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """For each row of `queries` (vec_id, v) its k best rows of `vectors` (vec_id, v): query_id, rank, vec_id, score.

    Both are tables of distinct ids and integer vectors, as `integers` gives them. The score is the inner product, missing components
    counting 0; ties go to the smaller id, and a query's own id is no candidate. Fewer than k candidates give as many rows; with
    no candidate or no query there are none. Scores must fit 64 bits.
    """
    vectors, queries = written(vectors, "topk-vectors"), written(queries, "topk-queries")
    v_blocks, q_blocks = vectors.count() // VECTORS + 1, queries.count() // QUERIES + 1
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = vectors.select(deal(1, v_blocks).alias("vb"), every(q_blocks).alias("qb"), F.lit(False).alias("is_query"), "vec_id", "v")
    q = queries.select(every(v_blocks).alias("vb"), deal(2, q_blocks).alias("qb"), F.lit(True).alias("is_query"), "vec_id", "v")
    dealt = v.union(q.select(v.columns)).withColumn("pair", F.col("vb") * q_blocks + F.col("qb"))
    dealt = dealt.repartition(F.col("pair")).sortWithinPartitions("pair").select("pair", "is_query", "vec_id", "v")
    found = mapped(dealt, _search(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""
