"""File sources and sinks: CSV in/out, read-or-build, in-memory rows, and
persistence of fitted state, evaluation tables and reports.

All scratch output goes under the shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local temp folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.session import checkpoint_dir, cut_lineage


def shared_dir(spark: SparkSession) -> str:
    return checkpoint_dir(spark)


def scratch_path(spark: SparkSession, prefix: str) -> str:
    return os.path.join(shared_dir(spark), f"{prefix}-{uuid.uuid4().hex}")


def schema_of(df: DataFrame) -> T.StructType:
    return df.schema


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, a directory of part files (one per task, never one file)."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Explicit schema: no inference pass, stable types on every read."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, corrupt: str = "_corrupt",
                     header: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: rows that fit the schema, and the lines (column
    ``line``) that don't -- too few or too many fields, or one of another type."""
    with_line = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    read = spark.read.schema(with_line).option("header", header).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", corrupt).csv(path)
    read = cut_lineage(read, "csv")       # parsed once for both
    return read.where(F.col(corrupt).isNull()).drop(corrupt), read.where(F.col(corrupt).isNotNull()).select(F.col(corrupt).alias("line"))


def save_tables(tables: dict[str, DataFrame], prefix: str, fmt: str = "csv") -> None:
    """The generator's two-table sink: ``<prefix>_<name>`` per table."""
    for name, df in tables.items():
        if fmt == "csv":
            write_csv(df, f"{prefix}_{name}")
        else:
            df.write.mode("overwrite").parquet(f"{prefix}_{name}")


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                  schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read ``path`` if present, else build the frame (and do not write it)."""
    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        if fmt == "csv":
            return reader.option("header", True).csv(path)
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return build()
        raise


def rows(spark: SparkSession, records: Iterable[dict], schema: T.StructType) -> DataFrame:
    """Rows from in-memory dicts (a form record, a sample transaction)."""
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def reset_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Empty a stored table (history / alerts reset), keeping its schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_text(df: DataFrame, path: str) -> None:
    """One string column to text lines (the report sink)."""
    df.coalesce(1).write.mode("overwrite").text(path)
