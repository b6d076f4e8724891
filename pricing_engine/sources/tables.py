"""Scans of the stored tables, with declared types and without null keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricing_engine.functions.text import iso_date, safe_number
from pricing_engine.schemas import TABLES, empty_table, require_columns


def _coerced(df: DataFrame, field: T.StructField) -> Column:
    """The column in its declared type; a value that does not fit becomes null."""
    column = F.col(field.name)
    if isinstance(field.dataType, T.DoubleType):
        return safe_number(column).alias(field.name)
    if df.schema[field.name].dataType == field.dataType:
        return column
    if isinstance(field.dataType, T.DateType):
        return iso_date(column).alias(field.name)
    return column.try_cast(field.dataType).alias(field.name)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Check, project and coerce a frame to a table's schema."""
    schema = TABLES[table]
    require_columns(df, schema.fieldNames(), table)
    return df.select(*[_coerced(df, field) for field in schema.fields])


def scan_table(
    spark: SparkSession,
    path: str,
    table: str,
    fmt: str = "parquet",
    missing_ok: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Read a table; an absent path gives an empty one if ``missing_ok``.

    Only absence is tolerated: a file that cannot be read stays an error.  CSV files
    are split among tasks unless ``multi_line`` says that values hold line ends.
    """
    try:
        if fmt == "csv":
            raw = spark.read.option("header", True).option("multiLine", multi_line).csv(path)
        else:
            raw = spark.read.format(fmt).load(path)
    except AnalysisException as error:
        absent = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
        if missing_ok and (error.getCondition() or "").startswith(absent):
            return empty_table(spark, TABLES[table])
        raise
    if not raw.columns and missing_ok:
        return empty_table(spark, TABLES[table])
    return conform(raw, table)


def valid_prices(history: DataFrame) -> DataFrame:
    """Rows with a date, a price and both key parts."""
    return history.dropna(subset=["date", "price", "product_id", "vendor"])


def scan_price_history(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return valid_prices(scan_table(spark, path, "price_history", fmt))
