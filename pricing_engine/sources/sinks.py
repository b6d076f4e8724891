"""Versioned tables on shared storage.

Every write goes to folders of its own and becomes current through the table's log,
so a failed job leaves the current version untouched, nobody overwrites what others
read, and of two writers neither loses its rows unnoticed.  The price history is
partitioned by date; tables by product are, in a store with buckets, partitioned by a
hash of the product.  A batch writes new folders for the partitions it touches, and
the next version names them beside the old folders of all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricing_engine.operators.history import ARRIVAL, PRODUCT_KEY, product_rows, upsert_history, upsert_registry
from pricing_engine.operators.metrics import fold_metrics
from pricing_engine.schemas import PARTITIONED_BY, SORT_ORDER, TABLES, empty_table
from pricing_engine.session import staged
from pricing_engine.sources.tables import conform
from pricing_engine.sources.versions import ConflictError, Source, Version, VersionLog

ATTEMPTS = 5
_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class TableStore:
    """The tables of the engine below one root folder.

    With ``buckets``, tables by product and by group are kept in that many partitions,
    so that a small batch costs the buckets it touches and not the whole table.  The
    history may be kept by month where days are too small for files of their own.
    """

    spark: SparkSession
    root: str
    buckets: int = 0
    history_by: str = "date"  # or "month"

    def log(self, table: str) -> VersionLog:
        return VersionLog(self.spark, f"{self.root}/{table}")

    def version(self, table: str) -> Version:
        return self.log(table).latest()

    def exists(self, table: str) -> bool:
        return self.version(table).number >= 0

    def partition(self, table: str) -> tuple[str, Column] | None:
        """Name and value of the column that a table is partitioned by."""
        by = PARTITIONED_BY.get(table)
        if by is None or (by != ["date"] and not self.buckets):
            return None
        if by == ["date"]:
            return self.history_by, F.col("date") if self.history_by == "date" else F.date_format("date", "yyyy-MM")
        return "bucket", F.pmod(F.xxhash64(*by), F.lit(self.buckets)).cast("int")

    def parts_of(self, table: str, rows: DataFrame) -> dict[str, str | None] | None:
        """Partitions of a table that rows belong to: as many as dates or buckets."""
        by = self.partition(table)
        if by is None:
            return None
        found = rows.select(by[1].cast("string")).distinct().collect()
        return {_NULL if r[0] is None else r[0]: None for r in found}

    def at(self, table: str, version: Version, parts: Iterable[str] | None = None) -> DataFrame:
        """A table as of a version, or some partitions of it."""
        folders = version.folders if parts is None else {p: version.folders[p] for p in parts if p in version.folders}
        if not folders:
            return empty_table(self.spark, TABLES[table])
        base = f"{self.root}/{table}"
        fields = [*TABLES[table].fields, T.StructField("v", T.StringType())]
        for name in ("bucket", "month"):
            if f"/{name}=" in next(iter(folders.values())):
                fields.append(T.StructField(name, T.StringType()))
        # folders that the log names must be there; their schema is known
        read = self.spark.read.schema(T.StructType(fields)).option("basePath", base)
        return conform(read.parquet(*[f"{base}/{f}" for f in version.paths(folders)]), table)

    def read(self, table: str, missing_ok: bool = True) -> DataFrame:
        version = self.version(table)
        if version.number < 0 and not missing_ok:
            raise FileNotFoundError(f"table {table} does not exist below {self.root}")
        return self.at(table, version)

    def read_for(self, table: str, rows: DataFrame) -> DataFrame:
        """The partitions of a table that could hold partners of ``rows``."""
        return self.at(table, self._checked(table, self.version(table)), self.parts_of(table, rows))

    def _checked(self, table: str, version: Version) -> Version:
        """The version, if it is dealt into as many buckets as this store's."""
        own = self.buckets if self.partition(table) and PARTITIONED_BY[table] != ["date"] else 0
        if version.folders and version.buckets != own:
            raise ValueError(f"{table} has {version.buckets} buckets, the store {own}")
        return replace(version, buckets=own)

    def _written(self, table: str, rows: DataFrame, number: int) -> dict[str, str]:
        """Folders by partition that now hold ``rows``, each in the table's order."""
        folder, order = self.log(table).new_folder(number), SORT_ORDER[table]
        path, by = f"{self.root}/{table}/{folder}", self.partition(table)
        if by is None:
            rows.orderBy(*order).write.parquet(path)
            return {"": folder}
        name, value = by
        if name == self.history_by:  # a range sort splits a date that holds much over several files
            rows = staged(rows, "version")  # it reads its rows twice
            rows.orderBy(*order).withColumn(name, value).write.partitionBy(name).parquet(path)
            return {p: f"{folder}/{name}={p}" for p in self.parts_of(table, rows)}
        dealt = rows.withColumn(name, value).repartition(name).sortWithinPartitions(name, *order)
        dealt.write.partitionBy(name).parquet(path)
        return self.log(table).parts_written(folder, name)

    def replace(self, table: str, rows: DataFrame, expected: int | None = None) -> DataFrame:
        """A new version with these rows only.

        It is a conflict if the table has moved on from ``expected``, or from where it
        was when the call began.
        """
        base = self._checked(table, self.version(table))
        if expected is not None and base.number != expected:
            raise ConflictError(f"{table} is at version {base.number}, not {expected}")
        new = base.after(None, self._written(table, conform(rows, table), base.number + 1), None)
        self.log(table).publish(new)
        return self.at(table, new)

    def update(
        self,
        table: str,
        change: Callable[[DataFrame], DataFrame],
        touched: DataFrame | None = None,
        source: Source | None = None,
    ) -> DataFrame:
        """The table after ``change``, a function from its rows to its new rows.

        With ``touched``, rows that name the partitions concerned, ``change`` gets and
        gives only those.  If another writer publishes first, this one's folders are
        published after it where the partitions are others, and computed anew where
        they are not.  A ``source`` that has been applied adds no version.
        """
        log = self.log(table)
        parts = self.parts_of(table, touched) if touched is not None else None
        for _ in range(ATTEMPTS):
            base = self._checked(table, log.latest())
            if base.has(source):
                return self.at(table, base)
            folders = self._written(table, conform(change(self.at(table, base, parts)), table), base.number + 1)
            now = base  # partitions that the change has emptied have no folder
            while now.same(base, parts) and not now.has(source):
                new = now.after(parts, folders, source)
                try:
                    log.publish(new)
                    return self.at(table, new)
                except ConflictError:
                    now = self._checked(table, log.latest())
        raise ConflictError(f"{table} was changed by others {ATTEMPTS} times")

    def create_missing(self) -> None:
        """Publish empty tables for those that do not exist yet."""
        for table in ("price_history", "products"):
            if not self.exists(table):
                try:
                    self.log(table).publish(Version(0))
                except ConflictError:  # another one has, meanwhile
                    pass

    def merge_history(self, new: DataFrame, arrival: str = ARRIVAL, source: Source | None = None) -> DataFrame:
        """The history after a batch: of its dates, the last row per product, vendor and category."""
        return self.update("price_history", lambda stored: upsert_history(stored, new, arrival), new, source)

    def merge_products(self, records: DataFrame, arrival: str = ARRIVAL, source: Source | None = None) -> DataFrame:
        """The registry after ingested records: the last one per product and vendor."""
        rows = product_rows(records).select(*TABLES["products"].fieldNames(), arrival)
        return self.update("products", lambda stored: upsert_registry(stored, rows, arrival), rows.dropna(subset=PRODUCT_KEY), source)

    def fold_metrics(self, prices: DataFrame, source: Source | None = None) -> DataFrame:
        """The bounds after a batch of prices."""
        return self.update("product_metrics", lambda stored: fold_metrics(stored, prices), prices, source)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of each table's newest ``keep`` versions names."""
        return sum(self.log(table).vacuum(keep) for table in TABLES if self.exists(table))


def export_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """A sorted CSV copy for other tools, with dates as ``yyyy-MM-dd``."""
    rows.orderBy(*order).write.mode("errorifexists").option("header", True).option(
        "dateFormat", "yyyy-MM-dd"
    ).csv(path)
