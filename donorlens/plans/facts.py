"""Narrow gift facts: the three sources of gifts before partner enrichment.

* ``posted_lines``  - booked move lines (the accounting ledger)
* ``history_lines`` - the earlier payment records (tagged 'npca')
* ``draft_lines``   - bank-statement lines not yet posted

Each returns one row per gift with only the columns the reports need; date
and account predicates are applied first so they reach the scan, and the
analytic-project triple is resolved with three lookups of the project table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .joins import lookup


def _between(col: str, start, end):
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(col) >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (F.col(col) <= F.lit(end).cast("date"))
    return cond


def accounts(t) -> DataFrame:
    return t.account_account.select(
        F.col("id").alias("aa_id"), F.col("code").alias("aa_code"), F.col("name").alias("aa_name")
    )


DIM_KEYS = ("analytic_dimension_1_id", "analytic_dimension_2_id", "analytic_dimension_3_id")


def _project_lookups(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Three left lookups of ``projects`` on the dimension ids of ``df``."""
    for k, key in enumerate(DIM_KEYS, start=1):
        keep = [df[c] for c in df.columns]
        dim = projects.alias(f"d{k}")
        df = df.join(dim, F.col(key) == F.col(f"d{k}.id"), "left").select(
            *keep, F.col(f"d{k}.code").alias(f"d{k}_code"), F.col(f"d{k}.name").alias(f"d{k}_name")
        )
    return df


def with_projects(df: DataFrame, t) -> DataFrame:
    """Attach code/name of analytic dimensions 1-3 (``d1_code`` ... ``d3_name``)
    by three left lookups of the project table (one scan of it, reused)."""
    return _project_lookups(df, t.account_analytic_account.select("id", "code", "name"))


def with_used_projects(df: DataFrame, t) -> DataFrame:
    """``with_projects`` for stored lines: a small pass over their ids finds the
    projects that they name, and only these are sent to the tasks."""
    used = df.select(F.explode(F.array(*DIM_KEYS)).alias("used_id")).where("used_id IS NOT NULL").distinct()
    projects = t.account_analytic_account.select("id", "code", "name")
    return _project_lookups(df, projects.join(used, F.col("id") == F.col("used_id"), "left_semi"))


def on_projects(t, pattern: str) -> Callable[[DataFrame], DataFrame]:
    """Keeps the lines of which any dimension is a project with a code like
    ``pattern``: the few ids meet the lines, not the whole project table."""
    ids = t.account_analytic_account.where(F.col("code").like(pattern)).select("id").distinct()

    def keep(lines: DataFrame) -> DataFrame:
        found = lines
        for k, key in enumerate(DIM_KEYS, start=1):
            found = found.join(ids.select(F.col("id").alias(f"on_{k}")), F.col(key) == F.col(f"on_{k}"), "left")
        return found.where(F.coalesce("on_1", "on_2", "on_3").isNotNull()).select(*lines.columns)

    return keep


def posted_lines(
    t,
    start=None,
    end=None,
    codes: Iterable[str] | None = None,
    *,
    with_company: bool = True,
    with_move: bool = True,
    projects: bool = True,
    restrict: Callable[[DataFrame], DataFrame] | None = None,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Move lines in [start, end] on the given ledger codes.

    ``restrict`` keeps (or repeats) only some of the lines of the period,
    before any of them meets another table.  ``stage`` stores the lines before
    they meet the projects and reads them back.

    The posting header (move) supplies only its name.  Where the name is
    wanted the lines are joined with the moves (inner join, at every size: a
    line without a move goes, a move that is there twice repeats its lines).
    Reports that do not print the name leave the join out (``with_move``
    False): a line's ``move_id`` is a mandatory foreign key to the moves'
    primary key, so there it neither drops nor repeats lines.
    """
    lines = t.account_move_line.where(_between("date", start, end))
    if restrict is not None:
        lines = restrict(lines)
    lines = lookup(lines, accounts(t), F.col("account_id") == F.col("aa_id"), "inner")
    if codes is not None:
        lines = lines.where(F.col("aa_code").isin(*codes))
    if with_company:
        company = t.res_company.select(F.col("id").alias("rc_id"), F.col("name").alias("rc_name"))
        lines = lookup(lines, company, F.col("company_id") == F.col("rc_id"), "inner")
    if with_move:
        moves = t.account_move.select(F.col("id").alias("am_id"), F.col("name").alias("am_name"))
        lines = lines.join(moves, F.col("move_id") == F.col("am_id"), "inner")
    if projects:
        lines = with_projects(lines, t) if stage is None else with_used_projects(stage(lines), t)
    return lines


def history_lines(t, start=None, end=None) -> DataFrame:
    """Payment-history rows that carry a project number (``> '0'``)."""
    return t.res_partner_payment_history.where((F.col("project_nbr") > F.lit("0")) & _between("date", start, end))


# Statement accounts left out of the draft-gift category report.
EXCLUDED_STATEMENT_ACCOUNTS = (4211, 4209, 2415, 2691, 2537, 4210, 2098, 2145, 2365, 2690, 2162, 2217, 2722, 2173, 2571)
DRAFT_STATEMENT_PATTERN = "%-288-%"


def draft_lines(t, start=None, end=None, codes: Iterable[str] | None = None) -> DataFrame:
    """Lines of draft bank statements of the gift journal, on gift accounts."""
    statements = t.account_bank_statement.where(
        F.col("name").like(DRAFT_STATEMENT_PATTERN) & (F.col("state") == "draft")
    ).select(F.col("id").alias("bs_id"))
    lines = t.account_bank_statement_line.where(_between("date", start, end))
    lines = lookup(lines, statements, F.col("statement_id") == F.col("bs_id"), "inner")
    lines = lookup(lines, accounts(t), F.col("account_id") == F.col("aa_id"), "inner")
    if codes is not None:
        lines = lines.where(F.col("aa_code").isin(*codes))
    lines = lines.where(~F.col("aa_id").isin(*EXCLUDED_STATEMENT_ACCOUNTS))
    return with_projects(lines, t)


# ---------------------------------------------------------------- projections
def project_code():
    return R.project_of("d1_code", "d2_code", "d3_code")


def project_name():
    return R.project_of("d1_name", "d2_name", "d3_name")
