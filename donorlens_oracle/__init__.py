"""Plain-SQL versions of the reports, run by DuckDB as the correctness oracle.

Each query is written directly from the report's definition (joins, CASE
expressions, GROUP BY), independently of the Spark plans; only the mapping of
the driver tables onto the ERP schema (``donorlens.sources.oracle_ctes``) is
shared, so both engines read the same input rows.
"""

from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL"]
