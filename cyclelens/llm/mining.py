"""Hard negatives from candidate blocks in Hilbert order, chosen by interval arithmetic over per-dimension zone maps.

Candidates are sorted by label and by their place on a Hilbert curve and written as a Parquet table of pages: a row holds some blocks of
neighbouring vectors, with the least and the largest component of each block in each dimension. Anchors are cut into groups the same way.
The product of a group's box and a page's box bounds every score between them, so a group is sent only to pages that can hold a row of one
of its windows; there, each anchor's own bounds choose the blocks that are scored. A first round reads the page nearest to each group, which
gives every window a floor that the second round's bounds must reach. Positives are one window of the anchor's label without limits,
negatives a window of the other labels below each positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclelens.llm.common import mapped, table, written

POSITIVES, NEGATIVES, SCALE, EVERY = 5, 5, 256, 100
#: A negative scores at least this share of its positive, in hundredths, and at most all of it.
LEAST_SHARE = 80
#: Vectors in a block, blocks in a page, anchors in a group.
BLOCK, BLOCKS, GROUP = 256, 16, 128
#: Bits of a component that place a vector on the curve.
BITS = 2
#: Page boxes that one group's box meets in a row of the pairing.
SHEET = 512

PAGE = "page long, at long, ids array<long>, labels array<long>, width int, data array<long>, lows array<long>, highs array<long>, label_low array<long>, label_high array<long>, low array<long>, high array<long>, least_label long, most_label long"
LOWEST, HIGHEST = -(2**62), 2**62


def hilbert(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of each row of cells (integers of `bits` bits) on the Hilbert curve of as many dimensions, as big-endian bytes.

    Skilling's transform: undo the excess work of each bit from the highest down, then the Gray code; the bits of all dimensions are
    interleaved, the highest first.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0]) if n else np.zeros(len(cells), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flips ^= np.where((x[-1] & q) != 0, q - 1, 0) if n else 0
        q >>= 1
    x ^= flips
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def labelled_integers(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x). Rows without id, label or vector, or with a null or non-finite component, are left out.

    An id is one vector: of rows that repeat it, the smallest vector stands, then the smallest label. An empty vector scores 0 with all.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    usable = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("x", finite))
    one = usable.groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("r"))
    return one.select("vec_id", F.col("r.label").alias("label"), F.transform("r.x", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _placed(width: int, low: list[int], high: list[int]):
    low, span = np.array(low, dtype=float), np.maximum(np.array(high, dtype=float) - np.array(low, dtype=float), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            cells = np.minimum(((m - low) / span * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, BITS), pa.binary())], names=[*batch.schema.names, "place"])

    return run


def _paged(width: int, block: int, blocks: int):
    """Rows in order become pages; `at` is the page's first row within its task, so (task, at) names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        rows = 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, rows, done
            whole = pa.Table.from_batches(held).combine_chunks()
            page, rest = whole.slice(0, n).combine_chunks(), whole.slice(n)
            held, rows = rest.to_batches(), rest.num_rows
            m, labels = _matrix(page.column("v").chunk(0), width), page.column("label").to_numpy()
            starts = range(0, n, block)
            out = {
                "page": task * 2**32 + done, "at": done, "ids": page.column("vec_id").to_numpy(), "labels": labels, "width": width, "data": m.ravel(),
                "lows": np.concatenate([m[s : s + block].min(axis=0) for s in starts]), "highs": np.concatenate([m[s : s + block].max(axis=0) for s in starts]),
                "label_low": [labels[s : s + block].min() for s in starts], "label_high": [labels[s : s + block].max() for s in starts],
                "low": m.min(axis=0), "high": m.max(axis=0), "least_label": labels.min(), "most_label": labels.max(),
            }
            done += n
            types = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.int32(), *[pa.list_(pa.int64())] * 7, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= block * blocks:
                yield cut(block * blocks)
        if rows:
            yield cut(rows)

    return run


def pages(vectors: DataFrame, width: int, low: list[int], high: list[int], label: str, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """`vectors` (vec_id, label, v) in the order of label, curve and id, written as pages with the zone maps of their blocks."""
    placed = mapped(vectors, _placed(width, low, high), "vec_id long, label long, v array<long>, place binary")
    ordered = placed.orderBy("label", "place", "vec_id").select("vec_id", "label", "v")
    return written(mapped(ordered, _paged(width, block, blocks), PAGE), label)


def boxes(paged: DataFrame, prefix: str) -> DataFrame:
    """The box of each page: least and largest component by dimension, least and largest label."""
    return paged.select(F.col("page").alias(f"{prefix}page"), *[F.col(n).alias(prefix + n) for n in ("low", "high", "least_label", "most_label")])


def _bounded(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of boxes whose scores may lie between wanted_low and wanted_high."""
        for batch in batches:
            sides = [_matrix(batch.column(n), width).astype(float) for n in ("g_low", "g_high", "p_low", "p_high")]
            corners = [g * p for g in sides[:2] for p in sides[2:]]
            least, most = (f.reduce(corners).sum(axis=1) for f in (np.minimum, np.maximum))
            # Sums of doubles may be off in the last bits: a relative slack keeps the bounds safe.
            slack = 1e-9 * np.maximum.reduce([np.abs(c) for c in corners]).sum(axis=1)
            fits = (most + slack >= batch.column("wanted_low").to_numpy()) & (least - slack <= batch.column("wanted_high").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("g_page"), batch.column("p_page"), pa.array(most)], names=["group", "page", "most"]).filter(pa.array(fits))

    return run


def meetings(groups: DataFrame, paged: DataFrame, same: bool, width: int) -> DataFrame:
    """(group, page, most): the pages that may hold rows of a group's windows, with the most that a score between the two boxes can be.

    `groups` has the box of each group (`boxes` with prefix g_) and wanted_low, wanted_high, the hull of its windows. Page boxes are dealt to
    sheets, and a group's box is sent to each sheet: narrow rows, some dozens of numbers for each group and sheet.
    """
    sheets = paged.count() // SHEET + 1
    p = boxes(paged, "p_").withColumn("sheet", F.pmod(F.xxhash64("p_page"), F.lit(sheets)))
    g = groups.withColumn("sheet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sheets - 1).cast("long"))))
    pairs = g.join(p, "sheet")
    if same:
        pairs = pairs.where("p_least_label <= g_most_label and g_least_label <= p_most_label")
    else:
        pairs = pairs.where("not (p_least_label = p_most_label and g_least_label = g_most_label and p_least_label = g_least_label)")
    columns = ["g_page", "p_page", "g_low", "g_high", "p_low", "p_high", "wanted_low", "wanted_high"]
    return mapped(pairs.select(columns), _bounded(width), "group long, page long, most double")


class Page:
    """A page's blocks: vectors, ids, labels and zone maps."""

    def __init__(self, ids, labels, width, data, lows, highs, label_low, label_high, block):
        self.ids, self.labels, self.width = np.asarray(ids), np.asarray(labels), width
        self.data = np.asarray(data).reshape(len(self.ids), width)
        self.lows, self.highs = np.asarray(lows).reshape(-1, width), np.asarray(highs).reshape(-1, width)
        self.label_low, self.label_high = np.asarray(label_low), np.asarray(label_high)
        self.block_of = np.arange(len(self.ids)) // block


def scan(page: Page, anchors: dict, same: bool, k: int) -> tuple[list[dict], int]:
    """The k best rows of the page in each window of a group's anchors, and how many (anchor, block) pairs were scored."""
    q = np.asarray(anchors["data"]).reshape(-1, page.width) if page.width else np.zeros((len(anchors["ids"]), 0), np.int64)
    ids, labels = np.asarray(anchors["ids"]), np.asarray(anchors["labels"])
    largest = max(np.abs(page.data).max(initial=0), 1) * max(np.abs(q).max(initial=0), 1) * max(page.width, 1)
    # Sums of products are exact in doubles below 2**53; beyond, integers are used.
    kind = np.float64 if float(largest) < 2**53 else np.int64
    up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    lows, highs = page.lows.astype(kind), page.highs.astype(kind)
    most, least = up @ highs.T + down @ lows.T, up @ lows.T + down @ highs.T
    if same:
        label_fits = (page.label_low <= labels[:, None]) & (labels[:, None] <= page.label_high)
    else:
        label_fits = ~((page.label_low == page.label_high) & (page.label_low == labels[:, None]))
    found, scored = [], 0
    data = page.data.astype(kind)
    for a in range(len(ids)):
        windows = anchors["windows"][a]
        if not windows:
            continue
        floor = min(max(w["low"], w["floor"]) for w in windows)
        ceiling = max(w["high"] for w in windows)
        chosen = label_fits[a] & (most[a] >= floor) & (least[a] <= ceiling)
        scored += int(chosen.sum())
        rows = np.flatnonzero(chosen[page.block_of])
        if not len(rows):
            continue
        fits = page.labels[rows] == labels[a]
        rows = rows[(fits if same else ~fits) & (page.ids[rows] != ids[a])]
        scores = (data[rows] @ q[a].astype(kind)).astype(np.int64)
        for w in windows:
            inside = np.flatnonzero((scores <= w["high"]) & (scores >= max(w["low"], w["floor"])))
            if len(inside) > k:
                kth = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
                inside = inside[scores[inside] >= kth]
            best = inside[np.lexsort((page.ids[rows[inside]], -scores[inside]))[:k]]
            found += [{"anchor_id": int(ids[a]), "window": w["window"], "vec_id": int(page.ids[rows[b]]), "score": int(scores[b])} for b in best]
    return found, scored


FOUND = "anchor_id long, window long, vec_id long, score long"
FOUND_ARROW = pa.schema([("anchor_id", pa.int64()), ("window", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
WINDOWS = "array<struct<window:long, low:long, high:long, floor:long>>"


def _scanned(same: bool, k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of page: the page itself first, then the groups sent to it. One page and one group are held."""
        page = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                if not row["is_group"].as_py():
                    flat = {n: row[n].values.to_numpy(zero_copy_only=False) for n in ("ids", "labels", "data", "lows", "highs", "label_low", "label_high")}
                    page = Page(**flat, width=row["width"].as_py(), block=block)
                    continue
                anchors = {n: row[n].values.to_numpy(zero_copy_only=False) for n in ("ids", "labels", "data")} | {"windows": row["windows"].as_py()}
                found, _ = scan(page, anchors, same, k)
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=FOUND_ARROW)

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def in_windows(groups: DataFrame, windows: DataFrame, paged: DataFrame, same: bool, k: int, width: int, block: int = BLOCK) -> DataFrame:
    """(anchor_id, window, rank, vec_id, score): the k best candidates of each window, higher scores first, then smaller ids.

    `groups` are pages of anchors; `windows` has (anchor_id, window, low, high), a few for each anchor. A window with fewer candidates gives
    as many rows as it has.
    """
    group_boxes = written(boxes(groups, "g_"), "mining-group-boxes")

    def round_of(windows: DataFrame, first: bool, taken: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        member = groups.select("page", F.posexplode("ids").alias("n", "anchor_id"))
        listed = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("window", "low", "high", "floor")).alias("windows"))
        by_anchor = member.join(listed, "anchor_id", "left")
        each = F.array_sort(F.collect_list(F.struct("n", F.coalesce("windows", F.array().cast(WINDOWS)).alias("w"))))
        gathered = by_anchor.groupBy("page").agg(F.transform(each, lambda x: x["w"]).alias("windows"))
        hull = lambda best, f: F.coalesce(best(F.flatten(F.transform("windows", lambda ws: F.transform(ws, f)))), F.lit(0))
        wanted = gathered.select(
            F.col("page").alias("g_page"), hull(F.array_min, lambda w: F.greatest(w["low"], w["floor"])).alias("wanted_low"), hull(F.array_max, lambda w: w["high"]).alias("wanted_high")
        )
        pairs = meetings(group_boxes.join(wanted, "g_page"), paged, same, width)
        if first:
            nearest = W.partitionBy("group").orderBy(F.col("most").desc(), "page")
            pairs = pairs.withColumn("nth", F.row_number().over(nearest)).where("nth = 1")
        pairs = written(pairs.select("group", "page"), "mining-pairs")
        left = pairs if taken is None else pairs.join(taken, ["group", "page"], "left_anti")
        sent = left.join(groups.join(gathered, "page").select(F.col("page").alias("group"), "ids", "labels", "width", "data", "windows"), "group")
        read = paged.join(left.select("page").distinct(), "page", "left_semi")
        nothing = F.lit(None).cast("array<long>")
        sent = sent.select("page", F.lit(True).alias("is_group"), "ids", "labels", "width", "data", nothing.alias("lows"), nothing.alias("highs"), nothing.alias("label_low"), nothing.alias("label_high"), "windows")
        read = read.select("page", F.lit(False).alias("is_group"), "ids", "labels", "width", "data", "lows", "highs", "label_low", "label_high", F.lit(None).cast(f"array<{WINDOWS}>").alias("windows"))
        met = read.union(sent).repartition("page").sortWithinPartitions("page", "is_group")
        return written(best(mapped(met, _scanned(same, k, block), FOUND), k).drop("rank"), "mining-found"), pairs

    open_windows = windows.withColumn("floor", F.lit(LOWEST))
    seeds, taken = round_of(open_windows, True, None)
    # A window that has k rows needs no row below the k-th best of them.
    floors = seeds.groupBy("anchor_id", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    raised = open_windows.drop("floor").join(floors.select("anchor_id", "window", F.col("kth").alias("floor")), ["anchor_id", "window"], "left")
    raised = written(raised.fillna(LOWEST, ["floor"]), "mining-windows")
    rest, _ = round_of(raised, False, taken)
    return best(seeds.union(rest), k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the best negatives for each anchor and positive.

    `vectors` and `anchors` are (vec_id, label, v) as `labelled_integers` gives them. An anchor's positives are its best other rows of its
    label; a negative has another label and a score of at least `least_share` hundredths of the positive's and at most all of it. An anchor
    without positives, a positive without negatives and empty tables give no rows. Shorter vectors count as filled with zeros; scores
    must fit 62 bits. Many equal vectors are one place on the curve and are told apart by id, so they fill as many pages as they need.
    """
    vectors, anchors = written(vectors, "mining-vectors"), written(anchors, "mining-anchors")
    width = vectors.union(anchors).agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # One number for each dimension: as many as a vector has.
    spread = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    low, high = [0] * width, [1] * width
    for r in spread:
        low[r.d], high[r.d] = r.low, r.high
    candidates = pages(vectors, width, low, high, "mining-pages", block)
    groups = pages(anchors, width, low, high, "mining-groups", block=GROUP, blocks=1)
    ids = groups.select(F.explode("ids").alias("anchor_id"))
    open_window = ids.select("anchor_id", F.lit(0).cast("long").alias("window"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
    near = in_windows(groups, open_window, candidates, True, positives, width, block)
    near = written(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("long").alias("window")), "mining-positives")
    floor = F.expr(f"-((-{least_share} * positive_score - pmod(-{least_share} * positive_score, 100)) div 100)")
    windows = near.select("anchor_id", "window", floor.alias("low"), F.col("positive_score").alias("high")).where("low <= high")
    far = in_windows(groups, windows, candidates, False, negatives, width, block)
    out = far.join(near, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = labelled_integers(rows.withColumn("label", moved), "vec_id", "embedding", "label")
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
