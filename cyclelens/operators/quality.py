"""Integrity checks on the base tables: keys, references, missing values and the shape of metric documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclelens import schemas
from cyclelens.domain import Domain


def pk_duplicates(domain: Domain) -> DataFrame:
    """(table_name, key, copies) of every key value that occurs more than once."""

    def repeated(table: str) -> DataFrame:
        keys = schemas.PRIMARY_KEYS[table]
        counted = domain.table(table).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
        return counted.select(
            F.lit(table).alias("table_name"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "copies"
        )

    return reduce(DataFrame.unionByName, [repeated(t) for t in schemas.TABLES])


def fk_orphans(domain: Domain) -> DataFrame:
    """(edge, n_orphans) for every reference.

    Child keys are counted before the join, so a value shared by very many rows travels as one row per task.
    """

    def orphans(child: str, column: str, parent: str, key: str) -> DataFrame:
        used = domain.table(child).groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        lost = used.join(domain.table(parent).select(F.col(key).alias("k")), "k", "left_anti")
        return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_orphans")).select(
            F.lit(f"{child}.{column}->{parent}.{key}").alias("edge"), "n_orphans"
        )

    return reduce(DataFrame.unionByName, [orphans(*edge) for edge in schemas.REFERENCES])


def null_violations(domain: Domain) -> DataFrame:
    """(table_name, column_name, nulls) for every required column, one pass per table."""

    def nulls(table: str) -> DataFrame:
        required = schemas.required_columns(table)
        counted = domain.table(table).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        return counted.unpivot([], required, "column_name", "nulls").select(F.lit(table).alias("table_name"), "column_name", "nulls")

    return reduce(DataFrame.unionByName, [nulls(t) for t in schemas.TABLES])


def metrics_validation(documents: DataFrame, column: str, required: tuple[str, ...]) -> DataFrame:
    """One row (ok, message): there are documents, each a JSON object holding the required keys."""
    keys = F.json_object_keys(F.col(column))
    counts = documents.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(keys.isNull()).alias("no_object"),
        F.count_if(keys.isNotNull() & ~F.forall(F.lit(list(required)), lambda k: F.array_contains(keys, k))).alias("incomplete"),
    )
    message = (
        F.when(F.col("n") == 0, "No metrics retrieved")
        .when(F.col("no_object") > 0, "Invalid JSON structure")
        .when(F.col("incomplete") > 0, "Missing required JSON keys")
        .otherwise("")
    )
    return counts.select((message == "").alias("ok"), message.alias("message"))
