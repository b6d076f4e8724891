"""Category rules: loaded once on the driver, used as a small table.

The configuration is written by hand, so its size is bounded by what its authors
type; Spark knows the size of the local table and decides on broadcasting itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricing_engine.schemas import CATEGORY_CONFIG


def load_config(path: str) -> dict[str, Any]:
    """Read ``{"categories": {...}}`` from a JSON or, with PyYAML present, a YAML file."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            return json.load(handle)
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML files need the PyYAML package; JSON works without") from error
        return yaml.safe_load(handle)


def specific_products(rules: Mapping[str, Any]) -> dict[str, list[str]]:
    """Vendor to identifiers; a plain list holds for every vendor of the category."""
    given = rules.get("specific_products", {})
    if isinstance(given, list):
        return {vendor: [str(p) for p in given] for vendor in rules.get("vendors") or []}
    if isinstance(given, Mapping):
        return {vendor: [str(p) for p in ids] for vendor, ids in given.items()}
    raise TypeError(f"specific_products must be a list or a mapping, not {type(given).__name__}")


def config_table(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    rows = [
        (
            position,
            category,
            list(rules.get("search_terms") or []),
            list(rules.get("vendors") or []),
            specific_products(rules),
            list(rules.get("must_include_terms") or []),
            list(rules.get("or_include_terms") or []),
            list(rules.get("must_exclude_terms") or []),
        )
        for position, (category, rules) in enumerate((config.get("categories") or {}).items())
    ]
    return spark.createDataFrame(rows, CATEGORY_CONFIG)


class UnknownCategoryError(ValueError):
    """A run names categories that the configuration lacks."""


def check_categories(config: Mapping[str, Any], requested: Iterable[str] | None) -> None:
    available = set(config.get("categories") or {})
    unknown = sorted(set(requested or []) - available)
    if unknown:
        raise UnknownCategoryError(f"unknown categories {unknown}; available: {sorted(available)}")


def config_summary(config: DataFrame) -> DataFrame:
    """Per category: its vendors in one text and the number of search terms."""
    return config.select(
        "category",
        F.array_join("vendors", ", ").alias("vendors"),
        F.size("search_terms").cast("bigint").alias("n_search_terms"),
    )


def fetch_targets(
    config: DataFrame,
    supported_vendors: Iterable[str],
    only_vendors: Iterable[str] | None = None,
    only_categories: Iterable[str] | None = None,
) -> DataFrame:
    """The (category, vendor) pairs to fetch, in configuration order."""
    targets = config.select(
        "position",
        "category",
        "search_terms",
        "specific_products",
        F.posexplode("vendors").alias("vendor_position", "vendor"),
    ).where(F.col("vendor").isin(list(supported_vendors)))
    if only_vendors:
        targets = targets.where(F.col("vendor").isin(list(only_vendors)))
    if only_categories:
        targets = targets.where(F.col("category").isin(list(only_categories)))
    specific = F.coalesce(F.try_element_at("specific_products", F.col("vendor")), F.array())
    return targets.select(
        "position",
        "vendor_position",
        "category",
        "vendor",
        F.size("search_terms").cast("bigint").alias("n_search_terms"),
        F.size(specific).cast("bigint").alias("n_specific"),
    )
