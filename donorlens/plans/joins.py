"""Join helpers that keep the physical plan scale-safe.

* ``lookup``: a plain join.  Spark broadcasts a side whose size it knows to be
  below its own threshold, from file statistics or, adaptively, from measured
  stage sizes; anything larger is a shuffle join with skewed partitions split.
  Nothing is counted while plans are built, so the plan rule is the same at
  every size.
* ``only_keys``: a fact table restricted to the keys that another, much smaller
  result names.  Up to ``KEY_LIMIT`` keys are read first and sent into the
  scan as a list (row groups without them are skipped); more of them are a
  semi-join.
* ``left_join_spread_nulls``: a left join whose fact-side key is often NULL
  (gifts without partner) would hash every NULL key into one reducer.  NULL
  keys cannot match, so they are replaced by a spread value that the join
  condition excludes; the facts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 4096


def lookup(fact: DataFrame, dim: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join a lookup table; Spark picks the strategy from its size."""
    return fact.join(dim, on, how)


def left_join_spread_nulls(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """``fact LEFT JOIN dim ON fact_key = dim_key`` with NULL keys dealt over all tasks."""
    spread = F.coalesce(F.col(fact_key), -1 - F.pmod(F.xxhash64(*fact.columns), F.lit(SPREAD)))
    keyed = fact.select("*", spread.alias("_spread_key"))
    on = (F.col("_spread_key") == F.col(dim_key)) & F.col(fact_key).isNotNull()
    return keyed.join(dim, on, "left").drop("_spread_key")


KEY_LIMIT = 1000


def only_keys(fact: DataFrame, key: str, keys: DataFrame, limit: int = KEY_LIMIT) -> DataFrame:
    """The rows of ``fact`` whose ``key`` is among the values of the single
    column of ``keys``; at most ``limit`` values reach the driver."""
    column = keys.columns[0]
    distinct = keys.where(F.col(column).isNotNull()).distinct()
    found = [row[0] for row in distinct.limit(limit + 1).collect()]
    if len(found) <= limit:
        return fact.where(F.col(key).isin(*found)) if found else fact.limit(0)
    return fact.join(distinct.select(F.col(column).alias("_only_key")), F.col(key) == F.col("_only_key"), "left_semi")
