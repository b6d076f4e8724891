"""Landed vendor responses: one row per search hit or product page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricing_engine.schemas import PAYLOADS, require_columns


def successful(payloads: DataFrame) -> DataFrame:
    """Rows with a 2xx status; API rows that carry no status count as successful."""
    return payloads.where(F.coalesce("status_code", F.lit(200)).between(200, 299))


def scan_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    raw = spark.read.schema(PAYLOADS).format(fmt).load(path)
    return successful(require_columns(raw, PAYLOADS.fieldNames(), "payloads"))
