"""Commits stored by month: planning, inspection, retention and re-dating."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens.functions.scalars import month_start, partition_name


def partition_plan(spark: SparkSession, start: date, end: date) -> DataFrame:
    """(partition_name, from_date, to_date) of every month from the start's up to, not including, the end date."""
    months = spark.range(1).select(
        F.explode(F.sequence(month_start(F.lit(start)), F.lit(end), F.expr("interval 1 month"))).alias("from_date")
    )
    return months.where(F.col("from_date") < F.lit(end)).select(
        partition_name("from_date").alias("partition_name"), "from_date", F.add_months("from_date", 1).alias("to_date")
    )


def partition_info(commits: DataFrame) -> DataFrame:
    """Rows per month, in order of time."""
    counted = commits.groupBy(month_start("commit_date").alias("from_date")).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(
        partition_name("from_date").alias("partition_name"),
        "from_date",
        F.add_months("from_date", 1).alias("to_date"),
        "row_count",
    ).orderBy("from_date")


def cutoff_month(as_of: date, months_to_keep: int) -> date:
    index = as_of.year * 12 + as_of.month - 1 - months_to_keep
    return date(index // 12, index % 12 + 1, 1)


def split_by_age(commits: DataFrame, as_of: date, months_to_keep: int = 12) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): whole months before the cutoff are archived. A plain date filter, so partitions are pruned."""
    old = F.col("commit_date") < F.lit(cutoff_month(as_of, months_to_keep))
    return commits.where(~old), commits.where(old)


def partition_retention(commits: DataFrame, as_of: date, months_to_keep: int = 12, archive: bool = True) -> DataFrame:
    """(partition_name, action, row_count): months archived or detached, kept, and the next three planned."""
    cutoff = F.lit(cutoff_month(as_of, months_to_keep))
    existing = commits.groupBy(month_start("commit_date").alias("m")).agg(F.count(F.lit(1)).alias("row_count"))
    action = F.when(F.col("m") < cutoff, "archived" if archive else "detached").otherwise("kept")
    report = existing.select(partition_name("m").alias("partition_name"), action.alias("action"), "row_count")
    first = as_of.replace(day=1)
    index = first.year * 12 + first.month + 2
    planned = partition_plan(commits.sparkSession, first, date(index // 12, index % 12 + 1, 1))
    fresh = planned.select("partition_name", F.lit("planned").alias("action"), F.lit(0).cast("bigint").alias("row_count"))
    return report.unionByName(fresh.join(report.select("partition_name"), "partition_name", "left_anti"))


def redate(commits: DataFrame, commit_id: str, new_date: date) -> DataFrame:
    """All commits, the named one under its new date."""
    moved = F.when(F.col("commit_id") == commit_id, F.lit(new_date)).otherwise(F.col("commit_date"))
    return commits.withColumn("commit_date", moved)


def write_by_month(commits: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Commits in one folder per month.

    The rebalance hint gathers a quiet month into few files and, by measured size, splits a busy one over many tasks.
    """
    by_month = commits.withColumn("commit_month", F.date_format("commit_date", "yyyyMM").cast("int"))
    (
        by_month.hint("rebalance", "commit_month")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("commit_month")
        .parquet(path)
    )


def read_by_month(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def recommit_date(spark: SparkSession, path: str, commit_id: str, new_date: date, staging: str) -> None:
    """Moves all stored rows of one commit to another date, rewriting only the months they leave and enter.

    The new content is staged first, then a journal names the months, then each month's folder is exchanged. A failure at any step restores
    the old state; a process that dies is followed up by the next call, which finishes a move that has a journal and forgets one that has none.
    """
    recover_move(spark, path, staging)
    stored = read_by_month(spark, path)
    # Every month that holds the id, of which there are no more than months.
    found = {r[0] for r in stored.where(F.col("commit_id") == commit_id).select("commit_month").distinct().collect()}
    if not found:
        raise LookupError(f"Commit {commit_id} not found")
    months = sorted(found | {new_date.year * 100 + new_date.month})
    move = _Move(spark, path, staging)
    try:
        affected = redate(stored.where(F.col("commit_month").isin(months)).drop("commit_month"), commit_id, new_date)
        write_by_month(affected, move.content)
        move.begin(months)
        move.finish()
    except Exception:
        move.undo()
        raise


def recover_move(spark: SparkSession, path: str, staging: str) -> None:
    """Ends a move that was cut short: by its journal if it got that far, else by dropping what was staged."""
    move = _Move(spark, path, staging)
    if move.months() is None:
        move.clear()
    else:
        move.finish()


class _Move:
    """The exchange of month folders for staged ones. What has been done is read off the folders, so each step may be repeated."""

    def __init__(self, spark: SparkSession, path: str, staging: str):
        self.root, self.fs = _folder(spark, path)
        self.staging, _ = _folder(spark, staging)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.content = f"{staging}/content"

    def _at(self, place: str, month: int):
        return self._path(f"{self.staging}/{place}" if place else str(self.root), f"commit_month={month}")

    def _rename(self, source, target) -> None:
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(source, target):
            raise OSError(f"{source} could not be moved to {target}")

    def begin(self, months: list[int]) -> None:
        """The journal: an empty folder for each month, named `new-` where the table has no such month yet; complete once it bears its name."""
        for month in months:
            known = "" if self.fs.exists(self._at("", month)) else "new-"
            self.fs.mkdirs(self._path(f"{self.staging}/journal-draft/{known}{month}"))
        self._rename(self._path(f"{self.staging}/journal-draft"), self._path(f"{self.staging}/journal"))

    def months(self) -> list[tuple[int, bool]] | None:
        """(month, whether it is new) by the journal, None without one."""
        journal = self._path(f"{self.staging}/journal")
        if not self.fs.exists(journal):
            return None
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(journal))
        return [(int(n.removeprefix("new-")), n.startswith("new-")) for n in names]

    def finish(self) -> None:
        """Sets each month's old folder aside and moves the new one, if commits are left for it, to its place."""
        for month, fresh in self.months():
            staged, old, live = self._at("content", month), self._at("old", month), self._at("", month)
            if not fresh and not self.fs.exists(old):
                self._rename(live, old)
            if self.fs.exists(staged):
                self._rename(staged, live)
        self.clear()

    def undo(self) -> None:
        """Puts the old folders back and forgets the move."""
        for month, fresh in self.months() or []:
            old, live = self._at("old", month), self._at("", month)
            if (fresh or self.fs.exists(old)) and self.fs.exists(live):
                self.fs.delete(live, True)
            if self.fs.exists(old):
                self._rename(old, live)
        self.clear()

    def clear(self) -> None:
        """The journal goes first: without it, what else is staged means nothing."""
        for name in ("journal", ""):
            place = self._path(f"{self.staging}/{name}") if name else self.staging
            if self.fs.exists(place):
                self.fs.delete(place, True)


def _folder(spark: SparkSession, path: str):
    """The Hadoop path and file system of a folder, in whatever store it is."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def month_sizes(spark: SparkSession, path: str) -> dict[int, int]:
    """Bytes stored per month, from the folder listing alone."""
    root, fs = _folder(spark, path)
    found = {}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("commit_month=") and name[13:].isdigit():
            found[int(name[13:])] = fs.getContentSummary(status.getPath()).getLength()
    return found


def stored_info(spark: SparkSession, path: str) -> DataFrame:
    """(partition_name, row_count, size_bytes) of commits stored by month: no column is read for it."""
    sizes = spark.createDataFrame(list(month_sizes(spark, path).items()), "commit_month int, size_bytes long")
    counts = read_by_month(spark, path).groupBy("commit_month").agg(F.count(F.lit(1)).alias("row_count"))
    named = F.concat(F.lit("commits_"), F.col("commit_month").cast("string")).alias("partition_name")
    return counts.join(F.broadcast(sizes), "commit_month").select(named, "row_count", "size_bytes")


def apply_retention(spark: SparkSession, path: str, as_of: date, months_to_keep: int = 12, archive: str | None = None) -> list[int]:
    """Moves the folders of months before the cutoff to the `archive` folder, or drops them without one; returns these months.

    A move renames folders within one store and rewrites nothing. Run again, it goes on where it stopped.
    """
    cutoff = cutoff_month(as_of, months_to_keep)
    old = sorted(m for m in month_sizes(spark, path) if m < cutoff.year * 100 + cutoff.month)
    if archive is None:
        drop_months(spark, path, set(old))
        return old
    root, fs = _folder(spark, path)
    target, _ = _folder(spark, archive)
    fs.mkdirs(target)
    jvm = spark.sparkContext._jvm
    for month in old:
        name = f"commit_month={month}"
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(root, name), jvm.org.apache.hadoop.fs.Path(target, name)):
            raise OSError(f"month {month} could not be moved to {archive}")
    return old


def drop_months(spark: SparkSession, path: str, months: set[int]) -> None:
    """Removes the folders of months that no longer hold any commit."""
    root, fs = _folder(spark, path)
    jvm = spark.sparkContext._jvm
    for month in months:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"commit_month={month}"), True)
