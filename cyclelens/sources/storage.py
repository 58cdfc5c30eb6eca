"""Stored result tables: each write makes a new folder, which readers see only once it is complete."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens.functions.scalars import instant
from cyclelens.operators.merge import replace_rows


class TableStore:
    """Tables below one shared folder.

    A write goes to the next version folder; Spark's `_SUCCESS` marker publishes it. A job that fails halfway, or an
    executor lost on the way, leaves the version before it in place, and no folder is overwritten while it is read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[str]:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.isDirectory())

    def _complete(self, name: str) -> list[str]:
        return [v for v in self._versions(name) if self._fs.exists(self._path(f"{self.root}/{name}/{v}/_SUCCESS"))]

    def exists(self, name: str) -> bool:
        return bool(self._complete(name))

    def read(self, name: str) -> DataFrame:
        complete = self._complete(name)
        if not complete:
            raise LookupError(f"No stored table: {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/{complete[-1]}")

    def put(self, name: str, df: DataFrame, version: int) -> DataFrame:
        """df as a certain version of the table; writing the same version again overwrites it."""
        path = f"{self.root}/{name}/v{version:010d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def get(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v{version:010d}")

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Full refresh: df becomes the table."""
        taken = self._versions(name)
        return self.put(name, df, int(taken[-1][1:]) + 1 if taken else 1)

    def upsert(self, name: str, new: DataFrame, key: str | Sequence[str], gone: DataFrame | None = None) -> DataFrame:
        """New rows replace stored rows of the same key; stored rows whose key is in `gone` and has no new row go; others stay.

        The new rows are computed once, then merged.
        """
        if not self.exists(name):
            return self.replace(name, new)
        delta = self.replace(f"{name}_delta", new)
        old = self.read(name) if gone is None else self.read(name).join(gone, key, "left_anti")
        return self.replace(name, replace_rows(old, delta, key))

    def expire(self, name: str, keep: int = 3) -> None:
        """Drops all but the newest versions; those kept leave time for readers of the version before the last."""
        for version in self._versions(name)[: -max(keep, 1)]:
            self._fs.delete(self._path(f"{self.root}/{name}/{version}"), True)

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows added to a growing table of small additions, such as a log."""
        rows.write.mode("append").parquet(f"{self.root}/{name}/v{1:010d}")

    def log_refresh(self, table: str, as_of: datetime) -> None:
        entry = self.spark.range(1).select(F.lit(table).alias("table_name"), instant(as_of).alias("refresh_time"))
        self.append("refresh_log", entry)


def bulk_replace(store: TableStore, name: str, loaded: DataFrame) -> DataFrame:
    """All-or-nothing load: the table changes only if every row could be read and written."""
    return store.replace(name, loaded)
