"""CSV ingest: header-bound columns, typed rows, and what could not be taken."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclelens import schemas
from cyclelens.functions.scalars import blank_to_null, leading_int, true_flag

BAD_LINE = "_bad_line"
# Doubled quotes inside a quoted field stand for one quote, as in RFC 4180.
FORMAT = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


@dataclass(frozen=True)
class Ingested:
    table: str
    accepted: DataFrame
    rejected: DataFrame
    invalid: DataFrame


def _typed(field: T.StructField) -> Column:
    name = field.name
    if isinstance(field.dataType, (T.LongType, T.IntegerType)):
        return leading_int(name, field.dataType.simpleString())
    if isinstance(field.dataType, T.DateType):
        return blank_to_null(name).try_cast("date")
    if isinstance(field.dataType, T.BooleanType):
        return true_flag(name)
    return F.coalesce(F.col(name), F.lit("")) if not field.nullable else F.col(name)


def typed_projection(raw: DataFrame, table: str, mode: str = "strict") -> DataFrame:
    """Raw text columns as the table's typed columns, bound by name.

    A required value that cannot be read fails the job in `strict` mode. In `quarantine` mode the row is kept and
    `invalid_columns` names what is wrong with it (empty text: nothing).
    """
    fields = schemas.SCHEMAS[table].fields
    missing = [f.name for f in fields if not f.nullable and f.name not in raw.columns and f.name != "ai_used"]
    if missing:
        raise ValueError(f"Missing required field: {', '.join(missing)} for {table}")
    absent = {f.name: F.lit(None).cast("string") for f in fields if f.name not in raw.columns}
    raw = raw.withColumns(absent) if absent else raw
    typed = raw.select(*[_typed(f).alias(f.name) for f in fields])
    wrong = F.concat_ws(",", *[F.when(F.col(f.name).isNull(), f.name) for f in fields if not f.nullable])
    judged = typed.withColumn("invalid_columns", wrong)
    if mode == "quarantine":
        return judged
    if mode != "strict":
        raise ValueError(f"Unknown mode: {mode}")
    failure = F.raise_error(F.concat(F.lit(f"Invalid value in {table}: "), F.col("invalid_columns")))
    return judged.where(F.when(F.col("invalid_columns") == "", True).otherwise(failure.cast("boolean"))).drop(
        "invalid_columns"
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by each file's own header, plus the line itself where its column count is wrong.

    Files of a folder may order their columns differently or leave some out; what a file lacks is NULL. A line that repeats its
    file's header is a header.
    """
    if not path or not isinstance(path, str):
        raise ValueError("Invalid file path")
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    except AnalysisException as error:
        raise FileNotFoundError(f"File not found: {path}") from error
    lines = lines.where(F.trim("value") != "")
    # A file's beginning is read by one task, in order, so the first line that it sees is the header.
    headers = lines.where("_at = 0").groupBy("_file").agg(F.first("value").alias("_header"))
    kinds = sorted(r[0] for r in headers.select("_header").distinct().collect())
    if not kinds:
        raise ValueError(f"Empty file: {path}")
    names = {kind: next(csv.reader([kind])) for kind in kinds}
    columns = list(dict.fromkeys(n for kind in kinds for n in names[kind]))
    if len(kinds) > 1:
        lines = lines.join(headers, "_file")
    out = None
    for kind in kinds:
        own, line = lines.where(F.col("value") != kind), F.col("value")
        if len(kinds) > 1:
            # What is parsed depends on the header too, so that no check of it is moved to where other files' lines are.
            own, line = own.where(F.col("_header") == kind), F.when(F.col("_header") == kind, F.col("value"))
        schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in [*names[kind], BAD_LINE])
        parsed = own.select(F.from_csv(line, schema, FORMAT | {"columnNameOfCorruptRecord": BAD_LINE}).alias("r"))
        field = lambda n, of=names[kind]: F.col("r").getField(n) if n in of else F.lit(None).cast("string")
        rows = parsed.select(*[field(n).alias(n) for n in columns], F.col("r").getField(BAD_LINE).alias(BAD_LINE))
        out = rows if out is None else out.unionByName(rows)
    return out


def ingest(spark: SparkSession, path: str, table: str, mode: str = "strict") -> Ingested:
    """One CSV file or folder as a typed table, its malformed lines, and (in quarantine) its unreadable rows."""
    if table not in schemas.SCHEMAS:
        raise ValueError(f"Unknown model: {table}")
    raw = read_raw(spark, path)
    well_formed = raw.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)
    rejected = raw.where(F.col(BAD_LINE).isNotNull()).select(F.col(BAD_LINE).alias("line"))
    typed = typed_projection(well_formed, table, mode)
    if mode == "strict":
        return Ingested(table, typed, rejected, typed.limit(0))
    bad = F.col("invalid_columns") != ""
    return Ingested(table, typed.where(~bad).drop("invalid_columns"), rejected, typed.where(bad))


def load_metrics(judged: DataFrame, table: str) -> DataFrame:
    """(table_name, total, successful, failed) of a load in quarantine mode."""
    failed = F.count_if(F.col("invalid_columns") != "")
    return judged.agg(F.count(F.lit(1)).alias("total"), failed.alias("failed")).select(
        F.lit(table).alias("table_name"), "total", (F.col("total") - F.col("failed")).alias("successful"), "failed"
    )


def bulk_read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The whole file or nothing: any line that does not fit the table's schema fails the job."""
    schema = schemas.SCHEMAS[table]
    options = FORMAT | {"header": "true", "mode": "FAILFAST", "enforceSchema": "false"}
    return spark.read.options(**options).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header="true", quote='"', escape='"').csv(path)
