"""The extracts as Spark SQL table functions with arguments of their own.

``register_functions(spark, t)`` defines, for this session:

* ``gift_ledger(of_partner, first_day, last_day)``: the 55-column gift list of one
  partner, or of all if ``of_partner`` is NULL or not positive (P-T01);
* ``gift_categories(period, as_of, first_day, last_day)``: gifts with their processing,
  donor, amount and count classes (P-T02);
* ``donor_profile(of_partner)``: lifetime statistics of one partner, no row
  without gifts (P-T03); it may be called laterally for every row of a table;
* ``marketing_income(period, first_day, last_day, job, as_of)``: booked income and
  payment history, lines without partner kept (P-T04); ``job`` is accepted as
  the original takes it, the run itself is logged by
  ``operators.extracts.append_audit``;
* ``period_first(period, as_of, first_day)`` and ``period_last(period,
  as_of, last_day)``: the borders of a report period (P-T05), any unknown code is an error.

Each table function is a query over a view without parameters, restricted by
its arguments.  Once a call's arguments are inlined, the optimizer pushes them
like any predicate: dates and partner reach the scans of both branches.  The
views are lazy plans; nothing is read before a call is executed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions import rules as R
from .operators import categories as CAT
from .operators import profile as PRO
from .plans import ledger as L

VIEW = "_donorlens_{}_rows"
PERIOD_ARGUMENTS = "period STRING, as_of DATE, {day} DATE"
NONE = "DEFAULT CAST(NULL AS DATE)"

#: name -> (arguments, restriction on the rows of the view)
SIGNATURES = {
    "gift_ledger": (
        "of_partner BIGINT, first_day DATE, last_day DATE",
        "rows.date BETWEEN first_day AND last_day AND (coalesce(of_partner, 0) <= 0 OR rows.partner_id = of_partner)",
    ),
    "gift_categories": (
        f"period STRING, as_of DATE {NONE}, first_day DATE {NONE}, last_day DATE {NONE}",
        "rows.datum BETWEEN period_first(period, as_of, first_day) AND period_last(period, as_of, last_day)",
    ),
    "donor_profile": ("of_partner BIGINT", "rows.partner_id = of_partner"),
    "marketing_income": (
        f"period STRING, first_day DATE, last_day DATE, job INT DEFAULT 10, as_of DATE {NONE}",
        "rows.date BETWEEN period_first(period, as_of, first_day) AND period_last(period, as_of, last_day)",
    ),
}


def rows_of(t, name: str) -> DataFrame:
    """All rows of an extract, before any argument restricts them."""
    if name == "gift_ledger":
        return L.income_ledger(t, None, None, R.GIFT_ACCOUNTS)
    if name == "gift_categories":
        return CAT.categories_between(t, None, None)
    if name == "donor_profile":
        return PRO.donor_profile(t)
    if name == "marketing_income":
        return L.income_ledger(t, None, None, R.MARKETING_ACCOUNTS, keep_unassigned=True, prefixed_bus=True)
    raise KeyError(name)


def _define_periods(spark: SparkSession) -> None:
    for border, day, year_to_date in (("first", "first_day", "make_date(year(as_of), 1, 1)"), ("last", "last_day", "as_of")):
        spark.sql(f"""
            CREATE OR REPLACE TEMPORARY FUNCTION period_{border}({PERIOD_ARGUMENTS.format(day=day)}) RETURNS DATE
            RETURN CASE
              WHEN period = 'CST' AND {day} IS NOT NULL THEN {day}
              WHEN period = 'YTD' AND as_of IS NOT NULL THEN {year_to_date}
              ELSE CAST(raise_error('unknown period code or missing day') AS DATE) END""")


def register_functions(spark: SparkSession, t, names=None) -> list[str]:
    """Define the table functions over the tables ``t``; returns their names."""
    _define_periods(spark)
    done = []
    for name in names or SIGNATURES:
        arguments, restriction = SIGNATURES[name]
        rows = rows_of(t, name)
        rows.createOrReplaceTempView(VIEW.format(name))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        chosen = ", ".join(f"rows.`{c}`" for c in rows.columns)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) "
                  f"RETURN SELECT {chosen} FROM {VIEW.format(name)} AS rows WHERE {restriction}")
        done.append(name)
    return done
