"""Table-function style extracts: gift ledger, marketing income, legacies."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules as R
from ..functions.period import resolve_period
from ..plans import ledger as L
from ..sources.schemas import MASTER_JOBS


def gift_ledger(t, start, end, partner_id: int | None = None) -> DataFrame:
    """All gifts of [start, end] (booked 732000/732100 + payment history),
    for every partner or only ``partner_id``; 55 columns."""
    return L.income_ledger(t, start, end, R.GIFT_ACCOUNTS, partner_id=partner_id)


def append_audit(spark: SparkSession, path: str, job_id: int, at: dt.datetime | None = None) -> None:
    """Record one run of an extract: (id, timestamp, job id) appended to a
    parquet table in a shared folder."""
    at = at or dt.datetime.now()
    # ordered by the second, unique however often the extract runs within it
    row_id = int(at.timestamp()) << 32 | uuid.uuid4().int >> 96
    spark.createDataFrame([(row_id, at, int(job_id))], MASTER_JOBS).coalesce(1).write.mode("append").parquet(path)


def marketing_income(
    t,
    period: str,
    start=None,
    end=None,
    job_id: int = 10,
    as_of=None,
    audit_path: str | None = None,
) -> DataFrame:
    """Booked income on gifts, legacies and subsidies plus payment history,
    lines without a partner kept; the run is logged when ``audit_path`` is
    given."""
    first, last = resolve_period(period, start, end, as_of)
    if audit_path is not None:
        append_audit(t.spark, audit_path, job_id)
    return L.income_ledger(t, first, last, R.MARKETING_ACCOUNTS, keep_unassigned=True, prefixed_bus=True)


def legacy_ledger(t, start, end, wide: bool = False) -> DataFrame:
    """Legacies of [start, end]; ``wide`` with address, donor and account columns."""
    return L.legacy_ledger(t, start, end, L.LEGACY_COLUMNS if wide else L.LEGACY_PRINTED)


def legacy_history(t, start, end, wide: bool = False) -> DataFrame:
    return L.legacy_history(t, start, end, L.LEGACY_COLUMNS if wide else L.LEGACY_PRINTED)


def ledger_extract(t, start, end) -> DataFrame:
    """The 49-column analyst ledger as one table."""
    return L.gift_ledger(t, start, end).wide()


def ledger_branch(t, start, end, branch: str) -> DataFrame:
    """One source of the analyst ledger (``active``, ``moved`` or ``history``)."""
    return L.branch_ledger(t, start, end, branch).wide()
