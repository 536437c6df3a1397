"""Table sources.

``ParquetTables`` reads an exported ERP / CRM database (one parquet folder per
table, declared schema, so scans prune columns and push filters).
``TestdataTables`` maps the driver's generated tables onto the same schema.
Both expose each table as an attribute returning a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import SCHEMAS, columns
from .testdata import TestdataTables, oracle_ctes, table_sql

__all__ = ["ParquetTables", "TestdataTables", "oracle_ctes", "table_sql", "SCHEMAS", "columns"]


class ParquetTables:
    """ERP tables stored as ``{root}/{table}`` parquet datasets."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self._memo: dict = {}

    def memo(self, key, build):
        """Build-once store for derived lazy plans keyed by ``key``."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        return self._cache[name]

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)
