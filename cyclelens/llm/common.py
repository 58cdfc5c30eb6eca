"""Tables in and out for the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens.session import work_dir

#: The white space that separates words wherever a contract names it: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared work folder and read back: its lineage ends there and its size is known to the planner."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Narrow rows that one task takes.
TASK_ROWS = 100_000


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """`df`, known to have at most `rows` narrow rows, in as many tasks as these need: many small rounds do not wait for empty tasks."""
    return df.coalesce(rows // TASK_ROWS + 1)


def mapped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`df.mapInArrow`, after this package has been sent to the executors as a job's Python file (once for each context)."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_cyclelens_sent", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        handle, path = tempfile.mkstemp(prefix="cyclelens-", suffix=".zip")
        with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as bundle:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        bundle.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
        context._cyclelens_sent = True
    return df.mapInArrow(function, schema)


#: Bytes of a batch of whole texts: it ends with the text that reaches them.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile gets its rows in batches of BATCH_BYTES. Spark's own are 16 times that, and a task holds one several times over,
    in the JVM and in Python. A limit of the session's own stays."""
    if spark.conf.get(_BATCH_LIMIT, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_LIMIT)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def named(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores more as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids that a join may broadcast: 16 MB of longs at most. A longer list is joined by a shuffle, with the same rows out.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast where its counted rows allow it. Wider rows count as four."""
    return F.broadcast(ids) if ids.count() * (1 if len(ids.columns) == 1 else 4) <= BROADCAST_IDS else ids


def text_key(text_col: str) -> Column:
    """What tells texts of one id apart; a null text counts as empty."""
    return F.xxhash64(text_or_empty(text_col))


def told_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """`docs` and the name of a column that tells its rows with an id apart.

    That is the id where none repeats. Else the rows are written with one column more, a number in the order of the ids, null where the id is.
    """
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return docs, id_col
    row = unused(docs, "__row")
    numbered = docs.orderBy(F.col(id_col), text_key(text_col)).withColumn(row, F.monotonically_increasing_id())
    return written(numbered.withColumn(row, F.when(F.col(id_col).isNotNull(), F.col(row))), "told-apart"), row


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str | None = None) -> DataFrame:
    """The rows of `docs`, all columns, whose id is not among `dropped` (one written column). A null id is never dropped.

    With `text_col`, `dropped` has a text_key as its second column, and only the id's rows with that text go.
    """
    names = ["__dropped_id", "__dropped_text"][: len(dropped.columns)]
    gone = sized(dropped).toDF(*names)
    same = docs[id_col] == gone["__dropped_id"]
    return docs.join(gone, same if text_col is None else same & (text_key(text_col) == gone["__dropped_text"]), "left_anti")


def picked(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is in `ids` (one written column)."""
    wanted = sized(ids).select(F.col(ids.columns[0]).alias("__wanted_id"))
    return docs.join(wanted, docs[id_col] == wanted["__wanted_id"], "left_semi")
