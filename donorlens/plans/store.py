"""Stored gift ledger and stored donor profile, loaded period by period.

``LedgerStore`` keeps the facts of the analyst ledger in two tables,
partitioned by (branch, year, month):

* ``facts`` is bucketed and sorted by partner, and so are the partner
  attributes.  One task writes, sorts or folds one bucket, so the first load
  makes as many as keep a bucket at about ``bucket_rows`` rows of that load,
  ``buckets`` at least; the number is kept beside the tables.  Both sides of the partner join are read bucket by bucket: the
  reports fold and join without a shuffle, and one partner's gifts are found by
  the files' statistics and Bloom filters (partner, project code, source).
* ``hot_facts`` takes the gifts of partners with more than ``hot_rows`` gifts
  in a load, spread over all tasks, so that no bucket holds a donor with a
  third of all rows.  Such partners are few: at most gifts / hot_rows.

``load`` stores the booked lines before they meet the projects: only projects
that these lines name, not the whole table, are then sent to every task.  It
overwrites the whole months that a period touches and no others, so
loading a period again, or an overlapping one, changes nothing.  A month
without gifts left is emptied: every load writes one marker row per month and
branch, without partner, which no report sees.  Gifts moved to a surviving
partner depend on the partner table of the day; ``remap`` rebuilds that branch
from the stored gifts, without reading a booked line.

``ProfileStore`` keeps partial statistics (count, sum, maximum) per partner,
source and year, partitioned by year.  ``load`` replaces years; ``profile``
merges the years, so neither a profile nor a report on it reads a booked line.

The tables are parquet folders under ``root`` (a new folder of the shared
checkpoint folder if not given), known to the session's catalog by a name.
"""

from __future__ import annotations

import calendar
import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.period import as_date
from ..session import checkpoint_dir, file_system, folder_exists
from . import ledger as L
from .facts import history_lines, posted_lines

BRANCHES = (L.ACTIVE, L.MOVED, L.HISTORY)
PARTITIONS = ("branch", "jaar", "maand")
BUCKETS = 64
BUCKET_ROWS = 250_000
HOT_ROWS = 1_000_000
# of both fact tables; the filters serve look-ups by other columns than the sorted one
BLOOM = {"parquet.bloom.filter.enabled#partner_id": "true", "parquet.bloom.filter.enabled#project_code": "true",
         "parquet.bloom.filter.enabled#bron": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def _root(spark: SparkSession, root: str | None, kind: str) -> str:
    return root.rstrip("/") if root else f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def whole_months(start, end) -> tuple[dt.date, dt.date]:
    """The first day of the first month and the last day of the last month of a period."""
    first, last = as_date(start), as_date(end)
    return first.replace(day=1), last.replace(day=calendar.monthrange(last.year, last.month)[1])


def months(start, end) -> list[tuple[int, int]]:
    first, last = whole_months(start, end)
    return [(n // 12, n % 12 + 1) for n in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


class _Tables:
    """Parquet tables of one store, created under its folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.prefix = f"donorlens_{uuid.uuid4().hex}"
        self.known: set[str] = set()

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def create(self, table: str, rows: DataFrame, partitions: tuple[str, ...] = (), bucket: str | None = None, buckets: int = 0,
               options: dict[str, str] | None = None) -> list[str]:
        """Creates (or finds again) a table with the columns of ``rows``; returns them in the table's order."""
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        order = [c for c in kinds if c not in partitions] + list(partitions)
        given = ", ".join(f"'{k}' '{v}'" for k, v in {"partitionOverwriteMode": "dynamic", **(options or {})}.items())
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({', '.join(f'`{c}` {kinds[c]}' for c in order)}) USING parquet OPTIONS ({given})"
            + (f" PARTITIONED BY ({', '.join(partitions)})" if partitions else "")
            + (f" CLUSTERED BY ({bucket}) SORTED BY ({bucket}) INTO {buckets} BUCKETS" if bucket else "")
            + f" LOCATION '{self.root}/{table}'")
        if partitions and table not in self.known and folder_exists(self.spark, f"{self.root}/{table}"):
            self.spark.catalog.recoverPartitions(self.name(table))  # what an earlier session has loaded
        self.known.add(table)
        return order

    def overwrite(self, table: str, rows: DataFrame, order: list[str]) -> None:
        """Replaces the partitions that ``rows`` hold, and only these."""
        rows.select(*order).write.insertInto(self.name(table), overwrite=True)

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def drop(self) -> None:
        """Forgets the tables; the files stay."""
        for row in self.spark.sql(f"SHOW TABLES LIKE '{self.prefix}_*'").collect():
            self.spark.sql(f"DROP TABLE {row['tableName']}")


class StoredLedger(L.GiftLedger):
    """A ledger read from a store: every report folds the bucketed gifts and
    those of the hot partners by themselves."""

    def __init__(self, parts: list[DataFrame], partners: DataFrame):
        facts = parts[0]
        for more in parts[1:]:
            facts = facts.unionByName(more)
        super().__init__(facts, partners)
        self.parts = parts

    def fact_parts(self) -> list[DataFrame]:
        return self.parts

    def wide(self) -> DataFrame:
        """The bucketed gifts meet their partners bucket by bucket; the other
        parts only the few partners that they hold, so no donor is one task's."""
        first, *rest = self.parts
        wide = L.GiftLedger(first, self.stored).wide()
        for part in rest:
            few = self.stored.join(part.select(F.col("partner_id").alias("hot_id")).distinct(), F.col("partner_id") == F.col("hot_id"), "left_semi")
            wide = wide.unionByName(L.GiftLedger(part, few).wide())
        return wide

    def rows(self, fact_filter=None, donor_filter=None) -> DataFrame:
        kept = self.parts if fact_filter is None else [p.where(fact_filter) for p in self.parts]
        wide = StoredLedger(kept, self.stored).wide()
        return wide if donor_filter is None else wide.where(donor_filter)


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = BUCKETS, hot_rows: int = HOT_ROWS, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.buckets, self.hot_rows, self.bucket_rows = spark, buckets, hot_rows, bucket_rows
        self.root = _root(spark, root, "gift-ledger")
        self.tables = _Tables(spark, self.root)
        if folder_exists(spark, self._kept()):
            self.buckets = spark.read.schema("buckets int").parquet(self._kept()).first()["buckets"]

    def _kept(self) -> str:
        return f"{self.root}/buckets"

    def _tasks(self, rows: int) -> int:
        return max(self.buckets, -(-rows // self.bucket_rows))

    def _fix_buckets(self, rows: int) -> None:
        """The number of buckets of a new store; that of one with tables stays."""
        if self.tables.known or folder_exists(self.spark, f"{self.root}/facts"):
            return
        self.buckets = self._tasks(rows)
        self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.mode("overwrite").parquet(self._kept())

    def _create_facts(self, facts: DataFrame) -> list[str]:
        self.tables.create("hot_facts", facts, PARTITIONS, options=BLOOM)
        return self.tables.create("facts", facts, PARTITIONS, "partner_id", self.buckets, BLOOM)

    def _markers(self, facts: DataFrame, branches: Iterable[str], loaded: Iterable[tuple[int, int]]) -> DataFrame:
        rows = [(b, y, m) for b in branches for y, m in loaded]
        values = ", ".join(f"('{b}', {y}, {m})" for b, y, m in rows)  # months and branches of one load
        have = self.spark.sql(f"SELECT * FROM VALUES {values} AS v({', '.join(PARTITIONS)})")
        return have.select(*[F.col(f.name).cast(f.dataType) if f.name in PARTITIONS else F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema.fields])

    def _write(self, facts: DataFrame, branches: Iterable[str], loaded: list[tuple[int, int]], partners: int = 0) -> None:
        staged, facts = self._stage(facts)  # the source is read once, whatever follows
        rows = facts.count()
        self._fix_buckets(max(rows, partners))
        order = self._create_facts(facts)
        sizes = facts.groupBy("partner_id").agg(F.count(F.lit(1)).alias("n"))
        hot = sizes.where(F.col("n") > self.hot_rows).select(F.col("partner_id").alias("hot_id"))
        is_hot = F.col("partner_id") == F.col("hot_id")
        markers = self._markers(facts, branches, loaded)
        # one task writes one bucket, so a partition has one file a bucket
        cold = facts.join(hot, is_hot, "left_anti").unionByName(markers).repartition(self.buckets, "partner_id")
        self.tables.overwrite("facts", cold, order)
        tasks = self._tasks(rows)
        spread = [*PARTITIONS, F.pmod(F.xxhash64(*[c for c in facts.columns if c not in PARTITIONS]), F.lit(tasks))]
        warm = facts.join(hot, is_hot, "left_semi").unionByName(markers).repartition(tasks, *spread).sortWithinPartitions("partner_id", "date")
        self.tables.overwrite("hot_facts", warm, order)
        self._unstage(staged)

    def _stage(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Rows of a load on their way, to be removed after it."""
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        return staged, self.spark.read.schema(rows.schema).parquet(staged)

    def _unstage(self, staged: str) -> None:
        system, where = file_system(self.spark, staged)
        system.delete(where, True)

    def load(self, t, start, end, codes=R.GIFT_ACCOUNTS) -> None:
        """Loads the whole months of [start, end] and the partner attributes."""
        first, last = whole_months(start, end)
        lines = []

        def stage(rows: DataFrame) -> DataFrame:
            # of lines without a partner no fact is made
            folder, kept = self._stage(rows.where("partner_id IS NOT NULL"))
            lines.append(folder)
            return kept

        self._write(L.loaded_facts(t, first, last, codes, stage), BRANCHES, months(first, last), t.res_partner.count())
        for folder in lines:
            self._unstage(folder)
        self.load_partners(t)

    def load_partners(self, t) -> None:
        attributes = L.stored_partners(t)
        order = self.tables.create("partners", attributes, (), "partner_id", self.buckets, BLOOM | {"partitionOverwriteMode": "static"})
        self.tables.overwrite("partners", attributes.repartition(self.buckets, "partner_id"), order)

    def remap(self, t) -> None:
        """Rebuilds the moved gifts from the stored ones and today's partners."""
        own = self._stored().where(F.col("branch") == L.ACTIVE)
        moved = own.join(L.successors(t), F.col("partner_id") == F.col("old_id"), "inner").select(
            *[c for c in own.columns if c not in ("partner_id", "inact_partner_id", "branch")], F.col("new_id").alias("partner_id"),
            F.col("old_id").alias("inact_partner_id"), F.lit(L.MOVED).alias("branch")).select(*own.columns)
        loaded = [(r["jaar"], r["maand"]) for r in self.tables.read("facts").where(F.col("branch") == L.ACTIVE).select("jaar", "maand").distinct().collect()]  # months
        self._write(moved, (L.MOVED,), loaded)

    def _stored(self) -> DataFrame:
        return self.tables.read("facts").unionByName(self.tables.read("hot_facts")).where("partner_id IS NOT NULL")

    def ledger(self, start=None, end=None) -> StoredLedger:
        """The loaded gifts, of [start, end] if given (only its months are read)."""
        parts = []
        for table in ("facts", "hot_facts"):
            rows = self.tables.read(table).where("partner_id IS NOT NULL")
            for border, sign in ((start, ">="), (end, "<=")):
                if border is not None:
                    day = as_date(border)
                    rows = rows.where(f"jaar * 12 + maand {sign} {day.year * 12 + day.month} AND date {sign} DATE '{day}'")
            parts.append(rows.select(*L.FACT_COLUMNS, "branch"))
        return StoredLedger(parts, self.tables.read("partners"))


class ProfileStore:
    """Partial gift statistics per partner, source and year."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = _root(spark, root, "donor-profile")
        self.tables = _Tables(spark, self.root)

    def load(self, t, first_year: int, last_year: int) -> None:
        """Replaces the statistics of these years."""
        start, end = dt.date(first_year, 1, 1), dt.date(last_year, 12, 31)
        booked = posted_lines(t, start, end, R.GIFT_ACCOUNTS, with_move=False, projects=False).select(
            "partner_id", F.lit("erp").alias("bron"), R.year_of("date").cast("int").alias("jaar"), R.gift_amount().cast(L.AMOUNT).alias("amount"))
        earlier = history_lines(t, start, end).select(
            "partner_id", F.lit("npca").alias("bron"), R.year_of("date").cast("int").alias("jaar"), F.col("amount").cast(L.AMOUNT).alias("amount"))
        parts = booked.unionByName(earlier).where("partner_id IS NOT NULL").groupBy("partner_id", "bron", "jaar").agg(
            F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"), F.max("amount").alias("mx"))
        order = self.tables.create("years", parts, ("jaar",))
        years = self.spark.range(first_year, last_year + 1).select(
            *[F.col("id").cast(f.dataType).alias(f.name) if f.name == "jaar" else F.lit(None).cast(f.dataType).alias(f.name) for f in parts.schema.fields])
        self.tables.overwrite("years", parts.unionByName(years).repartition("jaar", F.pmod(F.xxhash64("partner_id"), F.lit(16))), order)

    def partials(self) -> DataFrame:
        """partner_id, bron, y0, y1, n, s, mx: one row per partner and source."""
        return self.tables.read("years").where("partner_id IS NOT NULL").groupBy("partner_id", "bron").agg(
            F.min("jaar").alias("y0"), F.max("jaar").alias("y1"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("mx").alias("mx"))
