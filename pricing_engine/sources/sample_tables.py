"""The engine's tables as views over the order-line test data.

A shipped line is an observed price: the part is the product, the supplier's
region the vendor, the part's type the category.  Spark broadcasts a side when its
size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricing_engine.operators.history import ARRIVAL, ARRIVAL_TYPE, HISTORY_KEY, keep_last
from pricing_engine.operators.metrics import batch_metrics, group_metrics
from pricing_engine.session import staged



def arrival() -> Column:
    """Order key, line number (1 to 7), supplier key and ship day as one ascending number.

    Fewer columns would not tell all lines of a part apart.
    """
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(20,0)")
    supplied = line * F.lit(10**12).cast("decimal(13,0)") + F.col("l_suppkey")
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    return (supplied.cast("decimal(32,0)") * F.lit(10**5).cast("decimal(6,0)") + day).cast(ARRIVAL_TYPE)


_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


_LOOKUPS: dict[tuple[str, str], DataFrame] = {}


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier key to vendor, written once per application.

    Of a written table Spark knows the size.  Of a join it multiplies the sizes of its
    sides, and would take the lookup for larger than the lines that it is joined with.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _LOOKUPS:
        _LOOKUPS[key] = staged(_vendors(spark, sf_dir), "vendors")
    return _LOOKUPS[key]


def _vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier")
    return (
        suppliers.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("vendor"))
    )


def product_name() -> Column:
    """A shelf name from brand, name, size and a model number, in five spellings.

    Every sixteenth part goes without a model number.
    """
    model = (F.col("p_partkey") % 400 + 1000).cast("string")
    size = F.col("p_size").cast("string")
    brand, name = F.col("p_brand"), F.col("p_name")
    form = F.col("p_partkey") % 4
    return (
        F.when(F.col("p_partkey") % 16 == 0, F.concat(brand, F.lit(" "), name, F.lit(" "), size, F.lit(" pack")))
        .when(form == 1, F.concat(brand, F.lit(" "), name, F.lit(" ("), model, F.lit(") "), size, F.lit(" pack")))
        .when(form == 2, F.concat(brand, F.lit(" "), name, F.lit(" & case - "), model, F.lit(" "), size, F.lit(" pk")))
        .when(form == 3, F.concat(brand, F.lit(", "), name, F.lit(" / "), size, F.lit("ml "), model))
        .otherwise(F.concat(brand, F.lit(" "), name, F.lit(" "), size, F.lit(" ply "), model))
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_type").alias("category"),
        product_name().alias("product_name"),
    )


def records(spark: SparkSession, sf_dir: str, lines: str | None = None) -> DataFrame:
    """Every line, or those that a condition selects, as an ingested record."""
    rows = lines_of(spark, sf_dir)
    if lines is not None:
        rows = rows.where(lines)
    return (
        rows.join(vendors(spark, sf_dir), "l_suppkey")
        .join(parts(spark, sf_dir), "l_partkey")
        .select(
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_partkey").cast("string").alias("product_id"),
            "vendor",
            "product_name",
            "category",
            F.col("l_extendedprice").alias("price"),
            source().alias("source"),
            arrival().alias(ARRIVAL),
        )
    )


def source() -> Column:
    return F.when(F.col("l_partkey") % 3 == 0, "specific").otherwise("search")


def observations(spark: SparkSession, sf_dir: str, lines: str | None = None) -> DataFrame:
    """Every observed price, with its arrival number."""
    return records(spark, sf_dir, lines).drop("product_name", "source")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations as stored: the last one per date, product, vendor and category."""
    return keep_last(observations(spark, sf_dir), HISTORY_KEY)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (part, vendor), with the last date seen."""
    return (
        lines_of(spark, sf_dir)
        .join(vendors(spark, sf_dir), "l_suppkey")
        .groupBy("l_partkey", "vendor")
        .agg(F.max(F.col("l_shipdate").cast("date")).alias("last_seen"))
        .join(parts(spark, sf_dir), "l_partkey")
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry."""
    return listings(spark, sf_dir).select(
        F.col("l_partkey").cast("string").alias("product_id"),
        "vendor",
        "product_name",
        "category",
        source().alias("source"),
        "last_seen",
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group per part; its members are the part's vendors."""
    return listings(spark, sf_dir).select(
        F.col("l_partkey").alias("group_id"),
        F.col("product_name").alias("group_name"),
        "category",
        F.col("l_partkey").cast("string").alias("product_id"),
        "vendor",
        "product_name",
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-time bounds over the stored history."""
    return batch_metrics(price_history(spark, sf_dir))


def group_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_metrics(membership(spark, sf_dir), metrics(spark, sf_dir))
