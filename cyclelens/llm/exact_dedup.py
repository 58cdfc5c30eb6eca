"""Exact deduplication by content-defined chunk recipes, in DataFrame functions alone.

A normalised text is cut into chunks where its own characters say so. Chunks are deduplicated to identifiers, the identifiers are
verified against the chunks themselves, and documents are compared by their ordered lists of identifiers: a document moves as eight
bytes a chunk, and a chunk's characters move once for each task that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclelens.llm.common import SPACE, named, table, text_or_empty, told_apart, without, written

#: A chunk ends after a space that follows two of these characters; it has MIN to MAX characters, the last one of a text 1 to MAX.
BOUNDARY = r"(?<=[dgkmuy][dgkmuy.,!?] )"
MIN_CHUNK, MAX_CHUNK = 256, 4096
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:{BOUNDARY}|\z)|.{{{MAX_CHUNK}}}|.{{1,{MIN_CHUNK - 1}}}"


def normalised(text_col: str) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("text"))
    return text.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)).alias("chunks"))


def _hash(bits: int):
    """Identifier of a chunk: its 64-bit hash, of which a test may keep fewer bits to force clashes."""
    return lambda c: F.xxhash64(c) if bits == 64 else F.shiftrightunsigned(F.xxhash64(c), 64 - bits)


def clashes(chunked: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Verification: every chunk whose identifier another chunk has too, with its number among them (id, chunk, no).

    Chunks are compared by their characters, each distinct one once. With 64 bits the table is all but always empty.
    """
    distinct = chunked.select(F.explode("chunks").alias("chunk")).select(_hash(hash_bits)(F.col("chunk")).alias("id"), "chunk").distinct()
    shared = written(distinct.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "dedup-shared-ids")
    if shared.isEmpty():
        return shared.select("id", F.lit("").alias("chunk"), F.lit(0).alias("no")).limit(0)
    order = W.partitionBy("id").orderBy("chunk")
    return written(distinct.join(shared, "id").withColumn("no", F.row_number().over(order)), "dedup-clashes")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, recipe): the ordered, verified chunk identifiers of each row. Equal recipes mean equal normalised texts.

    An identifier that several chunks share is followed by the chunk's number among them.
    """
    chunked = _chunks(docs, id_col, text_col)
    plain = chunked.select("doc_id", "text_sha256", F.transform("chunks", _hash(hash_bits)).alias("recipe"))
    shared = clashes(chunked, hash_bits)
    if shared.isEmpty():
        return written(plain, "dedup-recipes")
    # Rows are told apart by their id and text hash; rows equal in both have one recipe.
    parts = chunked.dropDuplicates(["doc_id", "text_sha256"]).select("doc_id", "text_sha256", F.posexplode_outer("chunks").alias("at", "chunk"))
    parts = parts.withColumn("id", _hash(hash_bits)(F.col("chunk"))).join(shared, ["id", "chunk"], "left")
    spelled = parts.groupBy("doc_id", "text_sha256").agg(
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "id", F.coalesce("no", F.lit(0)).alias("no"))))).alias("ids")
    )
    spelled = spelled.select(
        F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"), F.flatten(F.transform("ids", lambda x: F.array(x["id"], x["no"].cast("long")))).alias("recipe")
    )
    rows = plain.select("doc_id", "text_sha256")
    return written(
        rows.join(spelled, rows["doc_id"].eqNullSafe(spelled["d"]) & (rows["text_sha256"] == spelled["s"])).select("doc_id", "text_sha256", "recipe"), "dedup-recipes"
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space became one space; a null text is an empty one, and all empty
    texts are equal. The smallest doc_id of a group stays. Rows that repeat an id and a text stand or fall together and count singly in
    group_size. A null id stays only if its group has no other (keep_id is then null). An empty table gives an empty result; other
    columns are not read.
    """
    rows = recipes(docs, id_col, text_col, hash_bits)
    # A group is counted before it is shuffled, and rows meet their group by a join whose large partitions Spark can split.
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(groups.select(F.col("recipe").alias("group_recipe"), "keep_id", "group_size"), "dedup-groups")
    out = rows.join(groups, rows["recipe"] == groups["group_recipe"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that repeat an earlier text; all columns as they are. Rows with a null id stay. Rows that share an id are
    decided on one by one, so that one row of a group stays."""
    rows, row = told_apart(docs, id_col, text_col)
    dropped = written(exact_duplicates(rows, row, text_col).where("not kept and doc_id is not null").select("doc_id").distinct(), "dedup-dropped")
    return without(rows, dropped, row).select([named(c) for c in docs.columns])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
