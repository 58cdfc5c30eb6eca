"""Merkle manifest of a data set: places by the rank of ids in bitmaps, levels by keyed arrays of slots.

Each group (a language) has a bitmap of its document ids: words of 64 bits, of which only those with a bit set are kept and which partial
aggregates merge by OR. A directory of set bits is summed up over words, blocks of 2**16 ids, and 2**32 and 2**48 above them, so that every
window is bounded and no table of documents is sorted: a document's place is its word's directory entry plus the set bits below its own.
Rows that repeat an id follow each other by leaf: their number beyond one is added to the directory.

2**HEIGHT consecutive places are one keyed array of slots, which one task reduces by that many levels; the arrays' roots are slots of the
arrays above. Paths come down the same tables. The subroots of all groups are the slots of one more tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclelens.llm.common import BROADCAST_IDS, mapped, table, written

#: Levels that one array of slots spans: 1,024 slots.
HEIGHT = 10


def sha(*inputs: str) -> str:
    """The dealt H: lower-case hex SHA-256 of the inputs one after another."""
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def field(c: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def below(count: Column, part: list[str], order: str) -> Column:
    """The sum of `count` over the rows of the part that come before."""
    return F.coalesce(F.sum(count).over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def directory(ids: DataFrame) -> DataFrame:
    """(group_no, word, bits, base): the words of each group's bitmap, and how many of the group's rows have an id in an earlier word.

    `ids` has group_no, id (not null) and times, one row for each different id. Each window takes the children of one parent: 1,024
    words of a block, or 65,536 blocks.
    """
    words = ids.groupBy("group_no", F.shiftright("id", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("bits"), F.sum("times").alias("rows")
    )
    words = written(words.withColumn("block", F.shiftright("word", 10)), "merkle-words")
    blocks = words.groupBy("group_no", "block").agg(F.sum("rows").alias("rows"))
    blocks = written(blocks.withColumn("above", F.shiftright("block", 16)).withColumn("top", F.shiftright("block", 32)), "merkle-blocks")
    above = blocks.groupBy("group_no", "top", "above").agg(F.sum("rows").alias("rows"))
    top = above.groupBy("group_no", "top").agg(F.sum("rows").alias("rows"))
    top = top.select("group_no", "top", below(F.col("rows"), ["group_no"], "top").alias("b3"))
    above = above.select("group_no", "top", "above", below(F.col("rows"), ["group_no", "top"], "above").alias("b2"))
    blocks = blocks.select("group_no", "top", "above", "block", below(F.col("rows"), ["group_no", "above"], "block").alias("b1"))
    based = blocks.join(above, ["group_no", "top", "above"]).join(top, ["group_no", "top"])
    based = based.select("group_no", "block", (F.col("b1") + F.col("b2") + F.col("b3")).alias("b"))
    counted = words.withColumn("b0", below(F.col("rows"), ["group_no", "block"], "word"))
    return counted.join(based, ["group_no", "block"]).select("group_no", "word", "bits", (F.col("b0") + F.col("b")).alias("base"))


def numbered(keys: DataFrame, key: str) -> DataFrame:
    """Different keys with their place from 0, null first, then by UTF-8 bytes: parts of a range sort, and one row a part to add up."""
    ordered = keys.select(key).distinct().orderBy(F.col(key).asc_nulls_first()).withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit(2**33 - 1))), "merkle-keys")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    first = parts.select("part", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("first"))
    return ordered.join(F.broadcast(first), "part").select(key, (F.coalesce("first", F.lit(0)) + F.col("at")).cast("long").alias("group_no"))


def placed(leaves: DataFrame) -> DataFrame:
    """`leaves` (group_no, id, leaf, ...) with `place`, from 0 within its group: rows without id first, then by id; rows that repeat an id by leaf.

    A repeated id, or all rows of a group without one, are counted, and only these are ranked among themselves.
    """
    times = written(leaves.groupBy("group_no", "id").agg(F.count("*").alias("times")), "merkle-ids")
    nulls = times.where("id IS NULL").select("group_no", F.col("times").alias("unnamed"))
    words = written(directory(times.where("id IS NOT NULL")), "merkle-directory")
    keyed = leaves.withColumn("word", F.shiftright("id", 6)).withColumn("bit", F.expr("cast(id & 63 as int)"))
    nulls, words = written(nulls, "merkle-unnamed"), words
    small = F.broadcast(words) if words.count() <= BROADCAST_IDS // 10 else words
    ranked = keyed.join(small, ["group_no", "word"], "left").join(F.broadcast(nulls) if nulls.count() <= BROADCAST_IDS // 10 else nulls, "group_no", "left")
    smaller = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    single = F.when(F.col("id").isNull(), 0).otherwise(F.col("base") + smaller + F.coalesce("unnamed", F.lit(0)))
    ranked = ranked.withColumn("place", single.cast("long")).drop("word", "bits", "base", "unnamed", "bit")
    again = times.where("times > 1")
    if again.isEmpty():
        return ranked
    return ranked_copies(ranked, times, again)


def ranked_copies(ranked: DataFrame, times: DataFrame, again: DataFrame) -> DataFrame:
    """Where ids repeat: rows before in the word count with all their copies, and copies follow each other by leaf.

    Equal leaves are counted first, so the window over the different leaves of an id holds one row for each; rows of one leaf take their places
    by number within their task's share, which is added up by share.
    """
    more = again.where("id IS NOT NULL").select("group_no", F.shiftright("id", 6).alias("word"), F.struct(F.col("id"), (F.col("times") - 1).alias("more")).alias("m"))
    more = more.groupBy("group_no", "word").agg(F.collect_list("m").alias("ms"))  # 64 ids at most
    shifted = ranked.withColumn("word", F.shiftright("id", 6)).join(more, ["group_no", "word"], "left")
    extra = F.expr("coalesce(aggregate(filter(ms, m -> m.id < id), 0L, (s, m) -> s + m.more), 0L)")
    shifted = shifted.withColumn("place", F.col("place") + extra).drop("ms", "word")
    shared = written(shifted.withColumn("share", F.spark_partition_id()), "merkle-shares")
    counts = shared.groupBy("group_no", "id", "leaf", "share").agg(F.count("*").alias("n"))
    whole = counts.groupBy("group_no", "id", "leaf").agg(F.sum("n").alias("n"))
    by_leaf = whole.select(F.col("group_no").alias("g"), F.col("id").alias("i"), F.col("leaf").alias("l"), below(F.col("n"), ["group_no", "id"], "leaf").alias("before_leaf"))
    by_share = counts.select(F.col("group_no").alias("g2"), F.col("id").alias("i2"), F.col("leaf").alias("l2"), F.col("share").alias("s2"), below(F.col("n"), ["group_no", "id", "leaf"], "share").alias("before_share"))
    in_share = F.row_number().over(W.partitionBy("group_no", "id", "leaf", "share").orderBy("place")) - 1
    out = shared.withColumn("nth", in_share)
    out = out.join(by_leaf, (F.col("group_no") == F.col("g")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("leaf") == F.col("l")))
    out = out.join(by_share, (F.col("group_no") == F.col("g2")) & F.col("id").eqNullSafe(F.col("i2")) & (F.col("leaf") == F.col("l2")) & (F.col("share") == F.col("s2")))
    out = out.withColumn("place", F.col("place") + F.col("before_leaf") + F.col("before_share") + F.col("nth"))
    return out.drop("share", "nth", "before_leaf", "before_share", "g", "i", "l", "g2", "i2", "l2", "s2")


def levels(n: int) -> int:
    """Levels above n leaves: while several nodes remain, two become one."""
    return (n - 1).bit_length()


def reduced(slots: list[str], steps: int) -> list[list[str]]:
    """The nodes of a run of slots level by level, `steps` levels up; a last node without a neighbour becomes the H of itself alone."""
    out = [slots]
    for _ in range(steps):
        low = out[-1]
        out.append([sha(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return out


def path(nodes: list[list[str]], slot: int) -> list[str]:
    """One step a level: `l` or `r` and the sibling on that side, or `-` where there is none."""
    out = []
    for level in nodes[:-1]:
        other = slot ^ 1
        out.append(("l" if other < slot else "r") + level[other] if other < len(level) else "-")
        slot >>= 1
    return out


def folded(digest: str, steps: list[str]) -> str:
    for s in steps:
        digest = sha(digest) if s == "-" else sha(s[1:], digest) if s[0] == "l" else sha(digest, s[1:])
    return digest


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of slots to their roots."""
    for batch in batches:
        roots = [reduced(slots, steps)[-1][0] for slots, steps in zip(batch.column("digests").to_pylist(), batch.column("steps").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("run"), pa.array(roots, pa.string())], names=["tree", "place", "digest"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of slots with the path of their root to the path of each slot."""
    schema = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("steps_up", pa.list_(pa.string()))])
    for batch in batches:
        for row in batch.to_pylist():
            nodes, above = reduced(row["digests"], row["steps"]), row["steps_up"] or []
            rows = [{"tree": row["tree"], "place": (row["run"] << HEIGHT) + slot, "steps_up": path(nodes, slot) + above} for slot in range(len(row["digests"]))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _runs(nodes: DataFrame, sizes: DataFrame, round_no: int, carried: list[str]) -> DataFrame:
    """Nodes (tree, place, digest, ...) as arrays of slots: at most 2**HEIGHT nodes an array, each in the slot of its place."""
    run = nodes.groupBy("tree", F.shiftright("place", HEIGHT).alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", *carried))).alias("slots"))
    steps = F.greatest(F.least(F.col("levels") - HEIGHT * round_no, F.lit(HEIGHT)), F.lit(0)).alias("steps")
    return run.join(sizes, "tree").select("tree", "run", F.col("slots.digest").alias("digests"), steps, *[F.col(f"slots.{c}").alias(c) for c in carried])


def _rounds(lowest: DataFrame, sizes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of every round above `lowest`, itself the first, and the roots (tree, place, digest)."""
    rounds = [lowest]
    for k in range(1, max(1, -(-most // HEIGHT)) + 1):
        nodes = written(mapped(rounds[-1].select("tree", "run", "digests", "steps"), _up, "tree long, place long, digest string"), "merkle-nodes")
        if k * HEIGHT >= most:
            return rounds, nodes
        rounds.append(written(_runs(nodes, sizes, k, []), "merkle-runs"))
    raise AssertionError("unreachable")


def _paths(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """(tree, run, steps_up): the path from each array of the first round up to the root; `top` is that of each tree."""
    steps = top
    for arrays in rounds[:0:-1]:
        below_them = arrays.join(steps, ["tree", "run"], "left").select("tree", "run", "digests", "steps", "steps_up")
        steps = written(mapped(below_them, _down, "tree long, place long, steps_up array<string>"), "merkle-paths").withColumnRenamed("place", "run")
    return steps


PROVEN = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), *[(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
    for batch in batches:
        for row in batch.to_pylist():
            nodes, above, out = reduced(row["digests"], row["steps"]), row["steps_up"] or [], []
            for slot, (id_, digest, claimed) in enumerate(zip(row["id"], row["digests"], row["claimed"], strict=True)):
                steps = path(nodes, slot) + above
                proof = sha(*[s[1:] for s in steps if s != "-"])
                root = folded(claimed, steps)
                out.append({"id": id_, "leaf": digest, "subroot": row["subroot"], "root": row["root"], "proof_sha256": proof, "folded_root": root, "verified": root == row["root"]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def manifest(leaves: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of `leaves` (group_key string, id long, leaf, claimed).

    `claimed` is the leaf that is to be verified. Groups are ordered by their key, null first, and within one the leaves by id, null first;
    rows that repeat an id are ordered by leaf. Every row is a leaf, and an empty table has none. A text's length only matters to who makes
    the leaf. Each level's siblings are the original ones.
    """
    leaves = written(leaves.select("group_key", "id", "leaf", "claimed"), "merkle-leaves")
    keys = written(numbered(leaves, "group_key").withColumnRenamed("group_key", "key"), "merkle-groups")
    small = F.broadcast(keys) if keys.count() <= BROADCAST_IDS // 10 else keys
    rows = leaves.join(small, F.col("group_key").eqNullSafe(F.col("key"))).drop("group_key", "key")
    at = placed(rows).withColumnRenamed("group_no", "tree").withColumnRenamed("leaf", "digest")
    at = written(at, "merkle-places")
    # ceil(log2(n)) levels, by exact integers: the bits of n - 1.
    bits = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    sizes = written(at.groupBy("tree").agg(F.count("*").alias("n")).select("tree", bits.cast("int").alias("levels")), "merkle-sizes")
    most = sizes.agg(F.max("levels")).first()[0]
    if most is None:
        return leaves.sparkSession.createDataFrame([], PROVEN)
    rounds, subroots = _rounds(written(_runs(at, sizes, 0, ["id", "claimed"]), "merkle-runs"), sizes, most)
    # The subroots are the leaves of one more tree, the groups' numbers their places.
    crown = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest")
    groups = sizes.count()
    crown_levels = levels(groups)
    crown_size = sizes.sparkSession.createDataFrame([(0, crown_levels)], "tree long, levels int")
    crown_rounds, root = _rounds(written(_runs(crown, crown_size, 0, []), "merkle-runs"), crown_size, crown_levels)
    # A tree that is lower than others has been carried up unchanged, so every path begins at run 0 of its last round.
    none = root.select("tree", F.lit(0).cast("long").alias("run"), F.array().cast("array<string>").alias("steps_up"))
    in_crown = crown_rounds[0].join(_paths(crown_rounds, none), ["tree", "run"], "left").select("tree", "run", "digests", "steps", "steps_up")
    tops = mapped(in_crown, _down, "tree long, place long, steps_up array<string>").select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("run"), "steps_up")
    tops = written(tops, "merkle-tops")
    ends = subroots.select("tree", F.col("digest").alias("subroot"), F.lit(0).cast("long").alias("crown"))
    ends = ends.join(F.broadcast(root.select(F.col("tree").alias("crown"), F.col("digest").alias("root"))), "crown")
    ends = F.broadcast(ends) if groups <= BROADCAST_IDS // 10 else ends
    arrays = rounds[0].join(_paths(rounds, tops), ["tree", "run"]).join(ends, "tree")
    return mapped(arrays.select("id", "digests", "claimed", "steps", "steps_up", "subroot", "root"), _prove, PROVEN)


#: Every seventh document by crc32 claims a leaf of one character more.
TAMPERED = 7


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    honest = leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    changed = leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars")), F.col("text")])
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    claimed = F.when(tampered & F.col("n_chars").isNotNull(), changed).otherwise(honest)
    leaves = docs.select(F.col("lang").alias("group_key"), F.col("doc_id").cast("long").alias("id"), honest.alias("leaf"), claimed.alias("claimed"))
    return manifest(leaves).withColumnRenamed("id", "doc_id")


_CRC_BIT = "list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                            lambda c, b: {_CRC_BIT}), 4294967295::BIGINT) AS crc
  FROM documents
), docs AS (
  SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)")} AS claimed,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i
  FROM crc
), inside AS (
  SELECT g, 0 AS h, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM docs
  UNION ALL
  SELECT g, h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM inside WHERE n > 1 GROUP BY g, h, i // 2
), subroots AS (
  SELECT g, d FROM inside WHERE n = 1
), crown AS (
  SELECT 0 AS h, g AS i, d, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM crown WHERE n > 1 GROUP BY h, i // 2
), walk AS (
  SELECT doc_id, g, 0 AS h, i, claimed AS d, '' AS sibs, FALSE AS up FROM docs
  UNION ALL
  SELECT doc_id, w.g, CASE WHEN w.up OR x.n > 1 THEN w.h + 1 ELSE 0 END, CASE WHEN w.up OR x.n > 1 THEN w.i // 2 ELSE w.g END,
         CASE WHEN NOT w.up AND x.n = 1 THEN w.d
              WHEN s.d IS NULL THEN sha256(w.d) WHEN w.i % 2 = 0 THEN sha256(w.d || s.d) ELSE sha256(s.d || w.d) END,
         w.sibs || CASE WHEN NOT w.up AND x.n = 1 THEN '' ELSE coalesce(s.d, '') END, w.up OR x.n = 1
  FROM walk w JOIN (SELECT FALSE AS up, g, h, i, n FROM inside UNION ALL SELECT TRUE, NULL, h, i, n FROM crown) x
         ON x.up = w.up AND (w.up OR x.g = w.g) AND x.h = w.h AND x.i = w.i
       LEFT JOIN (SELECT FALSE AS up, g, h, i, d FROM inside UNION ALL SELECT TRUE, NULL, h, i, d FROM crown) s
         ON s.up = w.up AND (w.up OR s.g = w.g) AND s.h = w.h AND s.i = xor(w.i, 1)
  WHERE NOT w.up OR x.n > 1
), ends AS (
  SELECT w.* FROM walk w JOIN crown c ON w.up AND w.h = c.h AND w.i = c.i AND c.n = 1
)
SELECT docs.doc_id, docs.leaf, subroots.d AS subroot, crown.d AS root, sha256(ends.sibs) AS proof_sha256, ends.d AS folded_root, ends.d = crown.d AS verified
FROM docs JOIN ends USING (doc_id) JOIN subroots ON docs.g = subroots.g JOIN crown ON crown.n = 1
"""
