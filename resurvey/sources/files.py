"""Typed reads, dataset writes, selector values and boundary extents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD_CELLS = "_bad_cells"


def _typed(name: str, kind: T.DataType) -> Column:
    """Cell text as the declared type, NULL when it does not fit."""
    text = F.col(name)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast(kind))
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def read_survey(spark: SparkSession, path: str, schema: T.StructType | str, na: str = "NA") -> DataFrame:
    """A1. CSV with a header and declared types; columns are found by name, others are not read.

    Empty cells and the ``na`` token are NULL.  A cell of the wrong type is NULL as well and is
    counted in ``_bad_cells`` of its row, so it is never dropped silently.  A missing column is
    an error.  No pass over the data is made to infer types.
    """
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    raw = spark.read.option("header", True).csv(path)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    cells = raw.select(*[F.nullif(F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit("")), F.lit(na)).alias(f.name) for f in schema])
    typed = {f.name: _typed(f.name, f.dataType) for f in schema}
    bad = sum(((F.col(n).isNotNull() & v.isNull()).cast("int") for n, v in typed.items()), F.lit(0))
    return cells.select(*[v.alias(n) for n, v in typed.items()], bad.alias(BAD_CELLS))


def scan_report(df: DataFrame) -> DataFrame:
    """A1. Row count, rows with a bad cell, and cells that are missing or could not be read."""
    data = [c for c in df.columns if c != BAD_CELLS]
    empty = sum((F.col(c).isNull().cast("long") for c in data), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(F.col(BAD_CELLS) > 0, 1)).alias("bad_rows"),
        F.sum(empty).alias("empty_cells"),
    )


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """A2. Persist a cleaned table (``csv``) or a result (``parquet``); returns the path."""
    writer = df.write.mode("errorifexists").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"fmt must be 'csv' or 'parquet', not {fmt!r}")
    return path


def filter_options(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4. Distinct values of every chosen column, long: (variable, value)."""
    text = df.select([F.col(c).cast("string").alias(c) for c in cols])
    return text.unpivot([], list(cols), "variable", "value").where(F.col("value").isNotNull()).distinct()


def extent_by_unit(df: DataFrame, unit: str, x: str, y: str, piece: str) -> DataFrame:
    """A5. Bounding box, centre and number of boundary pieces per unit."""
    return df.groupBy(unit).agg(
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
        F.min(y).alias("y_min"),
        F.max(y).alias("y_max"),
        ((F.min(x) + F.max(x)) / 2).alias("x_centre"),
        ((F.min(y) + F.max(y)) / 2).alias("y_centre"),
        F.count_distinct(piece).alias("pieces"),
    )


def files_in(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """``path`` of the files of a folder, wherever Spark can read; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
