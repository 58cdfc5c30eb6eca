"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning of signatures, exact verification of survivors.

Equal shingle sets are one node from the start, so copies cost nothing further. In each bucket all nodes are first compared with the
bucket's smallest; the verified links give components, and only pairs that a bucket still holds in different components are compared
after that, in blocks of bounded size. Pairs that the signatures cannot rule out are verified on their whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens.llm.common import in_few_tasks, mapped, named, picked, table, told_apart, without, written
from cyclelens.llm.components import components
from cyclelens.llm.words import mixed, shingle_set, texts_as_words

SHINGLE = 5
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature positions compared at a time, and the posterior probability of a link below which a pair is given up.
BATCH, MISS = 16, 1e-6
#: Nodes on either side of one comparison block, about.
BLOCK = 1024

_RNG = np.random.Generator(np.random.PCG64(9))
_MULTIPLY = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash signature of a set of 64-bit shingle hashes: 32 bits for each of HASHES functions."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    folded = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(folded), 2048):
        h = folded[k : k + 2048, None] * _MULTIPLY + _ADD
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(least, h.min(axis=0), out=least)
    return least


@lru_cache(maxsize=8)
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest equal positions with which a pair goes on.

    With a uniform prior, m equal of n positions leave the similarity a Beta(m + 1, n - m + 1) posterior; its mass at or above the
    threshold t is the chance that a binomial of n + 1 trials and probability t is at most m.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, 0
        while True:
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def surviving(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the signature arrays x and y are not ruled out, batch by batch, and in how many positions these agree."""
    at, equal = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (x[at, part] == y[at, part]).sum(axis=1)
        on = equal >= least
        at, equal = at[on], equal[on]
    return at, equal


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, signatures = [], [], []
        for h in texts_as_words(batch.column(1)):
            s = shingle_set(h, SHINGLE)
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            signatures.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
            names=["doc_id", "n_shingles", "set_key", "signature"],
        )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of each row; key and signature are null for an empty set."""
    rows = docs.select(F.col(id_col).cast("long"), text_col)
    return written(mapped(rows, _sign, "doc_id long, n_shingles long, set_key binary, signature binary"), "near-signatures")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    first = np.frombuffer(places, np.int64)[column.offset]
    return np.frombuffer(data, np.uint32, len(column) * HASHES, first).reshape(len(column), HASHES)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep, _ = surviving(_matrix(batch.column(2)), _matrix(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts to pairs that are links; rows of one b come together, so its set is made once."""
    last_id, last = None, np.zeros(0, np.uint64)
    for batch in batches:
        ids, a, b = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
        linked = []
        for k in range(batch.num_rows):
            text = b[k].as_py()
            if (ids[k], text) != last_id:
                last_id, last = (ids[k], text), _set_of(b.slice(k, 1))
            other = _set_of(a.slice(k, 1))
            both = len(np.intersect1d(other, last, assume_unique=True))
            if 100 * both >= PERCENT * (len(other) + len(last) - both) and both:
                linked.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(linked, pa.int64())), batch.column(1).take(pa.array(linked, pa.int64()))], names=["a", "b"])


def _set_of(column: pa.Array) -> np.ndarray:
    return shingle_set(next(texts_as_words(column)), SHINGLE)


def _like_size(x: str, y: str) -> str:
    return f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})"


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that are links by their whole sets. Only texts of documents in a pair are moved."""
    pairs = written(pairs, "near-survivors")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = written(in_few_tasks(ids, 2 * pairs.count()), "near-survivor-ids")
    texts = picked(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ids, "id")
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return mapped(both, _verify, "a long, b long").distinct()


def _contiguous(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that agree in `keys`, which come one after another, as one table for each group."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if kept is not None:
            rows = pa.concat_tables([kept, rows]).combine_chunks()
        change = np.zeros(rows.num_rows - 1, dtype=bool)
        for key in keys:
            x = rows.column(key).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1), rows.num_rows]
        for first, last in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield rows.slice(first, last - first)
        kept = rows.slice(cuts[-2])
    if kept is not None:
        yield kept


#: Survivors that one block gives for each of its nodes; a block with more gives each node's likeliest alone and stays open.
AT_ONCE = 1


def _survivors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one block, in different components, that neither sizes nor signatures rule out, and their equal positions.

    A pair that several bands bring together is compared in the first of them alone; pairs with the bucket's pivot have been before.
    """
    node, label, size, block = (rows.column(c).to_numpy() for c in ("node", "label", "n_shingles", "block"))
    band, pivot, left, right = (rows.column(c)[0].as_py() for c in ("band", "pivot", "left", "right"))
    x, y = (np.flatnonzero(block == left), np.flatnonzero(block == right))
    sig = np.concatenate([_matrix(c) for c in rows.column("signature").chunks])
    i, j = (m.ravel() for m in np.meshgrid(x, y, indexing="ij"))
    ok = (label[i] != label[j]) & (100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j]))
    ok &= (node[i] != pivot) & (node[j] != pivot) & ((left != right) | (node[i] < node[j]))
    i, j = i[ok], j[ok]
    found = [(np.zeros(0, np.int64),) * 3]
    for k in range(0, len(i), 8192):
        p, q = i[k : k + 8192], j[k : k + 8192]
        if band:
            early = (sig[p, : band * ROWS] == sig[q, : band * ROWS]).reshape(len(p), band, ROWS).all(axis=2).any(axis=1)
            p, q = p[~early], q[~early]
        on, equal = surviving(sig[p], sig[q])
        found.append((p[on], q[on], equal))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors (a, b) of each block, and the buckets (open) that have more."""
    out: tuple[list, list, list] = ([], [], [])
    for rows in _contiguous(batches, ["bucket", "left", "right"]):
        if rows.num_rows < 2:
            continue
        node = rows.column("node").to_numpy()
        p, q, equal = _survivors(rows)
        if len(p) > AT_ONCE * rows.num_rows:
            likeliest = np.zeros(len(p), dtype=bool)
            for side in (p, q):
                order = np.lexsort((-equal, side))
                likeliest[order[np.append(True, side[order][1:] != side[order][:-1])]] = True
            p, q = p[likeliest], q[likeliest]
            out[0].append(None), out[1].append(None), out[2].append(rows.column("bucket")[0].as_py())
        out[0].extend(node[p].tolist()), out[1].extend(node[q].tolist()), out[2].extend([None] * len(p))
        if len(out[0]) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "open"])
            out = ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "open"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each block whose rows bring their whole sets: survivors are verified from the likeliest on, and those whose nodes
    an earlier link of the block has joined are passed over, so that a block gives fewer links than it has rows."""
    for rows in _contiguous(batches, ["bucket", "left", "right"]):
        if rows.num_rows < 2:
            continue
        node, label = rows.column("node").to_numpy(), rows.column("label").to_numpy()
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in rows.column("shingles")]
        root: dict[int, int] = {}

        def find(x: int, root=root) -> int:
            while x in root:
                x = root[x]
            return x

        p, q, equal = _survivors(rows)
        out: list[tuple[int, int]] = []
        for k in np.argsort(-equal, kind="stable"):
            x, y = find(label[p[k]]), find(label[q[k]])
            if x != y:
                a, b = sets[p[k]], sets[q[k]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= PERCENT * (len(a) + len(b) - both):
                    root[max(x, y)] = min(x, y)
                    out.append((node[p[k]], node[q[k]]))
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.int64()) for n in (0, 1)], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(h, SHINGLE).tobytes() for h in texts_as_words(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["of", "shingles"])


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, band, node, pivot) of every node that shares a bucket with another; the pivot is the bucket's smallest node."""
    places = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("signature", 4 * ROWS * b + 1, 4 * ROWS)).alias("bucket")) for b in range(BANDS)]
    keyed = nodes.select("node", F.explode(F.array(*places)).alias("at")).select("node", "at.band", "at.bucket")
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared.select("bucket", "pivot"), "near-buckets")
    return written(keyed.join(shared, "bucket").select("bucket", "band", "node", "pivot"), "near-members")


def _pruned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that neither their sizes nor their signatures rule out."""
    side = nodes.select("node", "signature", "n_shingles")
    joined = pairs.join(side.toDF("a", "sig_a", "n_a"), "a").join(side.toDF("b", "sig_b", "n_b"), "b").where(_like_size("n_a", "n_b"))
    return mapped(joined.select("a", "b", "sig_a", "sig_b"), _prune, "a long, b long")


def _block(label: Column, number: Column) -> Column:
    """A block's name within its bucket; two blocks of one name would be searched as one."""
    return F.xxhash64(label.cast("long"), number.cast("long"))


def _meetings(sizes: DataFrame) -> DataFrame:
    """(bucket, block, left, right): the pairs of blocks that hold different components, each with either of its blocks.

    `sizes` has a row for each bucket and label. Blocks of one component do not meet, so a bucket whose nodes are joined but for a few has
    about as many rows to exchange as nodes.
    """
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    large = sizes.where("own is not null").select("bucket", "label", "own")
    own = large.select("bucket", "label", numbers(F.col("own")).alias("k")).select("bucket", _block(F.col("label"), F.col("k")).alias("y"))
    shared = sizes.where("mixed > 0").select("bucket", "mixed").distinct().select("bucket", numbers(F.col("mixed")).alias("k"))
    shared = shared.select("bucket", _block(F.lit(None), F.col("k")).alias("x"))
    within = shared.join(shared.select("bucket", F.col("x").alias("y")), "bucket").where("x <= y")
    other = large.select("bucket", F.col("label").alias("label_y"), F.col("own").alias("own_y"))
    apart = large.join(other, "bucket").where("label < label_y").withColumn("k", numbers(F.col("own"))).withColumn("m", numbers(F.col("own_y")))
    apart = apart.select("bucket", _block(F.col("label"), F.col("k")).alias("x"), _block(F.col("label_y"), F.col("m")).alias("y"))
    pairs = within.union(shared.join(own, "bucket").select("bucket", "x", "y")).union(apart)
    pairs = pairs.select("bucket", F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))
    return pairs.select("bucket", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"), "left", "right").distinct()


def _blocks(members: DataFrame, labels: DataFrame, columns: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, dealt to blocks of bounded size, each pair of blocks one after another.

    `columns` has a row of further columns for each node (of, ...).
    """
    named = members.join(labels, members["node"] == labels["of"], "left").select("bucket", "band", "node", "pivot", F.coalesce("label", "node").alias("label"))
    named = written(named, "near-labelled")
    sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    split = sizes.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("n").alias("rows"), F.sum(F.when(F.col("n") < BLOCK, F.col("n"))).alias("small"))
    split = split.where("labels > 1 and rows > 2").select("bucket", F.ceil(F.coalesce("small", F.lit(0)) / BLOCK).alias("mixed"))
    sizes = written(sizes.join(split, "bucket").withColumn("own", F.when(F.col("n") >= BLOCK, F.ceil(F.col("n") / BLOCK))), "near-split-buckets")
    sides = written(_meetings(sizes), "near-block-pairs")
    # A component of a block or more has blocks of its own; the others share some.
    of_bucket, of_label = F.col("of_bucket") == named["bucket"], F.col("of_label") == named["label"]
    held = named.join(sizes.select(F.col("bucket").alias("of_bucket"), F.col("label").alias("of_label"), "own", "mixed"), of_bucket & of_label)
    of = F.when(F.col("own").isNotNull(), _block(F.col("label"), F.pmod(F.xxhash64("node"), F.col("own")))).otherwise(_block(F.lit(None), F.pmod(F.xxhash64("node"), F.col("mixed"))))
    held = held.select("bucket", "band", "node", "pivot", "label", of.alias("block")).join(sides, ["bucket", "block"])
    held = held.select("bucket", "band", "node", "pivot", "label", "block", "left", "right")
    held = held.join(columns, held["node"] == columns["of"]).drop("of")
    return held.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (of, label) of nodes, with the components that `links` (a, b) join as one."""
    side = lambda c: F.coalesce(F.col(f"label_{c}"), F.col(c)).alias(c)
    lifted = links.join(labels.toDF("of_a", "label_a"), F.col("a") == F.col("of_a"), "left").join(labels.toDF("of_b", "label_b"), F.col("b") == F.col("of_b"), "left")
    joined = components(lifted.select(side("a"), side("b"))).toDF("was", "root")
    known = labels.union(joined.join(labels, joined["was"] == labels["of"], "left_anti").select("was", "was"))
    again = joined.toDF("had", "now")
    return written(known.join(again, known["label"] == again["had"], "left").select("of", F.coalesce("now", "label").alias("label")), "near-labels")


def _grouped(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(of, label): the component of every node that is linked with another.

    After the stars, each bucket's blocks are searched. A block with few survivors gives them all; one with many, as among thousands of
    copies of a text, gives the likeliest first, which leaves few components, and then is searched once more with its whole sets at hand.
    """
    members = _buckets(nodes)
    stars = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    none = nodes.sparkSession.createDataFrame([], "of long, label long")
    labels = _merged(none, verified(_pruned(stars, nodes), docs, id_col, text_col))
    signed = nodes.select(F.col("node").alias("of"), "signature", "n_shingles")
    found = written(mapped(_blocks(members, labels, signed), _across, "a long, b long, open long"), "near-across")
    labels = _merged(labels, verified(found.where("a is not null").select("a", "b").distinct(), docs, id_col, text_col))
    still = written(found.where("open is not null").select(F.col("open").alias("still")).distinct(), "near-open")
    if still.isEmpty():
        return labels
    members = written(members.join(still, members["bucket"] == still["still"], "left_semi"), "near-open-members")
    ids = written(members.select("node").distinct(), "near-open-nodes")
    texts = picked(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ids, "id")
    sets = written(mapped(texts, _sets, "of long, shingles binary").distinct(), "near-sets")
    whole = signed.join(sets.withColumnRenamed("of", "set_of"), F.col("of") == F.col("set_of")).drop("set_of")
    return _merged(labels, mapped(_blocks(members, labels, whole), _linked, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct 5-word shingles, words being runs of other than white space with A-Z lower-cased; a text of 1 to 4
    words is one shingle. An empty or null text has an empty set, is linked with nothing and stays. Two documents are linked if 100 *
    intersection >= 75 * union; the component's smallest id names it, and the document of that id stays. Rows that repeat an id share a
    component. A row with a null id takes no part: its component_id is null and it stays. Other columns are not read.
    """
    signed = signatures(docs, id_col, text_col)
    nodes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")
    )
    nodes = written(nodes, "near-nodes")
    labels = _grouped(nodes, docs, id_col, text_col).withColumnRenamed("label", "root")
    smallest = written(labels.groupBy("root").agg(F.min("of").alias("component")), "near-smallest")
    of_node = labels.join(smallest, "root").select("of", "component")
    classes = nodes.select("set_key", "node", "copies").join(of_node, F.col("node") == F.col("of"), "left")
    classes = classes.where("copies > 1 or component is not null").select(F.col("set_key").alias("class_key"), F.coalesce("component", "node").alias("component"))
    classes = written(classes, "near-classes")
    out = signed.join(classes, signed["set_key"] == classes["class_key"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group of near duplicates; all columns as they are. Rows with a null id stay; rows that share an id
    are decided on one by one."""
    rows, row = told_apart(docs, id_col, text_col)
    dropped = written(near_duplicates(rows, row, text_col).where("not kept").select("doc_id").distinct(), "near-dropped")
    return without(rows, dropped, row).select([named(c) for c in docs.columns])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS shingles FROM w
), x AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), y AS (
  SELECT * FROM x SEMI JOIN (SELECT shingle FROM x GROUP BY shingle HAVING count(*) > 1) USING (shingle)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM y a JOIN y b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
