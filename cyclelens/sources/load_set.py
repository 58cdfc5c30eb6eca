"""All base tables loaded as one set: staged, checked, and published together or not at all."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens import schemas
from cyclelens.domain import Domain
from cyclelens.operators import quality
from cyclelens.sources.storage import TableStore

PUBLISHED = "published_set"


def violations(domain: Domain) -> DataFrame:
    """(check, subject, n): repeated keys by table, orphans by reference, nulls by required column; what is in order has no row."""
    repeated = quality.pk_duplicates(domain).groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("key").alias("check"), F.col("table_name").alias("subject"), "n")
    orphans = quality.fk_orphans(domain).select(F.lit("reference").alias("check"), F.col("edge").alias("subject"), F.col("n_orphans").alias("n"))
    nulls = quality.null_violations(domain).select(F.lit("null").alias("check"), F.concat_ws(".", "table_name", "column_name").alias("subject"), F.col("nulls").alias("n"))
    return reduce(DataFrame.unionByName, [repeated, orphans, nulls]).where("n > 0")


class LoadSets:
    """Sets of the six base tables below one folder, of which the last published one is what readers open.

    Each load writes its tables to a folder of its own. One small table names the folder of the current set; its `_SUCCESS` marker publishes all six
    tables at once. A load that fails, or does not pass the checks, changes nothing for readers, who keep the set that they opened.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), TableStore(spark, root)

    def _folders(self) -> list[str]:
        return self.store._versions("sets")

    def current(self) -> Domain:
        """The published set; none yet is a LookupError."""
        folder = self.store.read(PUBLISHED).first()[0]
        return Domain.from_folder(self.spark, f"{self.root}/sets/{folder}")

    def load(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """Stages the tables, checks them, publishes them if nothing was found; returns what was found.

        A table that is not given is taken from the published set, so that references are checked across old and new. The checks read the
        staged tables, as they will be read later, and not what they were made from.
        """
        unknown = set(tables) - set(schemas.TABLES)
        if unknown:
            raise ValueError(f"Unknown tables: {sorted(unknown)}")
        before = self.current() if self.store.exists(PUBLISHED) else None
        missing = set(schemas.TABLES) - set(tables)
        if missing and before is None:
            raise ValueError(f"The first set lacks {sorted(missing)}")
        taken = self._folders()
        name = f"v{int(taken[-1][1:]) + 1 if taken else 1:010d}"
        for table in schemas.TABLES:
            rows = tables[table] if table in tables else before.table(table)
            rows.select(*schemas.columns(table)).write.parquet(f"{self.root}/sets/{name}/{table}")
        staged = Domain.from_folder(self.spark, f"{self.root}/sets/{name}")
        found = TableStore(self.spark, self.root).replace("set_violations", violations(staged).withColumn("set_name", F.lit(name))).drop("set_name")
        if found.isEmpty():
            self.store.replace(PUBLISHED, self.spark.createDataFrame([(name,)], "folder string"))
        return found

    def expire(self, keep: int = 2) -> None:
        """Drops the folders of all but the newest published sets, and of loads that were refused or failed before them."""
        published = [self.spark.read.parquet(f"{self.root}/{PUBLISHED}/{v}").first()[0] for v in self.store._complete(PUBLISHED)[-keep:]]
        for folder in self._folders():
            if folder not in published and (not published or folder < published[-1]):
                self.store._fs.delete(self.store._path(f"{self.root}/sets/{folder}"), True)
