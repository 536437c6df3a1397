"""Recurring project donors.

Donors with a gift in [start, end] whose gifts to one project, looked at from
``history_start`` to ``end``, span at least a year at one gift per month or
more.

The report numbers the gifts of each (partner, project code) with
ROW_NUMBER under an order that ties every row, then keeps MAX(row number)
per (partner, code, project name).  Any row order is a valid execution of
that; we fix "project name (NULL last), then date, then amount".  Under that
order the last row number of a project name is the count of rows up to and
including that name, so it follows from per-name counts with a running sum
over the (few) names of a code - no window over the gift rows, which would
put a hot donor's whole history into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.period import as_date
from ..plans import partner as P
from ..plans.facts import history_lines, posted_lines, project_code, project_name

AMOUNT = "decimal(16,2)"
TOTAL = "decimal(18,2)"


def window_donors(t, start, end) -> DataFrame:
    """Partners with a booked gift in [start, end] (active or deceased)."""
    lines = posted_lines(t, start, end, R.GIFT_ACCOUNTS, with_company=False, with_move=False, projects=False)
    eligible = t.res_partner.where(R.active_or_deceased("active", "deceased")).select(F.col("id").alias("e_id"))
    return lines.join(eligible, F.col("partner_id") == F.col("e_id"), "left_semi").select(F.col("partner_id").alias("d_id")).distinct()


def project_folds(t, start, end, history_start) -> DataFrame:
    """All gifts up to ``end``, read once and folded per (partner, code,
    project): total, first and last date and number since ``history_start``,
    money booked and money recorded from ``start`` on, and whether the partner
    has a booked gift from ``start`` on (the same in all rows of a partner)."""
    since, first = as_date(history_start), min(as_date(start), as_date(history_start))
    booked = posted_lines(t, first, end, R.GIFT_ACCOUNTS, with_company=False, with_move=False).select(
        "partner_id",
        R.gift_amount().cast(AMOUNT).alias("bedrag"),
        project_code().alias("project_code"),
        project_name().alias("project"),
        "date",
        F.lit(True).alias("booked"),
    )
    hist = history_lines(t, first, end).select(
        "partner_id",
        F.col("amount").cast(AMOUNT).alias("bedrag"),
        R.history_project("project_nbr", "cost_center").alias("project_code"),
        F.lit(None).cast("string").alias("project"),
        "date",
        F.lit(False).alias("booked"),
    )
    recent = F.col("date") >= F.lit(since)
    window = F.col("date") >= F.lit(as_date(start))
    folds = (
        booked.unionByName(hist).where(F.col("partner_id").isNotNull())
        .groupBy("partner_id", "project_code", "project")
        .agg(
            *_span_totals(recent),
            F.sum(F.when(window & F.col("booked"), F.col("bedrag"))).alias("booked_window"),
            F.sum(F.when(window & ~F.col("booked"), F.col("bedrag"))).alias("history_window"),
            F.max(window & F.col("booked")).alias("gave"),
        )
    )
    # over the projects of a partner, not over the partner's gifts
    return folds.withColumn("gave", F.max("gave").over(Window.partitionBy("partner_id")))


def _span_totals(recent: Column) -> list[Column]:
    return [
        F.sum(F.when(recent, F.col("bedrag"))).cast(TOTAL).alias("bedrag"),
        F.min(F.when(recent, F.col("date"))).alias("first_date"),
        F.max(F.when(recent, F.col("date"))).alias("last_date"),
        F.sum(F.when(recent, 1).otherwise(0)).alias("n"),
    ]


def _with_spans(folds: DataFrame) -> DataFrame:
    running = (
        Window.partitionBy("partner_id", "project_code")
        .orderBy(F.col("project").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return folds.select(
        *[c for c in folds.columns if c not in ("first_date", "last_date", "n")],
        R.whole_years("first_date", "last_date").alias("periode_j"),
        R.whole_months("first_date", "last_date").cast("int").alias("periode_m"),
        F.sum("n").over(running).cast("bigint").alias("r"),
    )


def project_spans(gifts: DataFrame) -> DataFrame:
    """Per (partner, code, project) of ``gifts``: total, span in years /
    months and the last row number of the project in its (partner, code) group."""
    return _with_spans(gifts.groupBy("partner_id", "project_code", "project").agg(*_span_totals(F.lit(True))))


def donor_spans(t, start, end, history_start) -> DataFrame:
    """``project_folds`` with spans, and ``regular``: a project that the
    partner, who gave from ``start`` on, has supported for at least a year at
    one gift per month or more."""
    spans = _with_spans(project_folds(t, start, end, history_start))
    regular = F.col("gave") & (F.col("periode_j") >= 1) & (F.try_divide(F.col("r"), F.col("periode_m")) >= 1)
    return spans.withColumn("regular", F.coalesce(regular, F.lit(False)))


def recurring_project_donors(t, start, end, history_start) -> DataFrame:
    spans = donor_spans(t, start, end, history_start).where("regular")
    pdim = P.partner_dim(t, ("country", "street", "city")).where(
        F.col("c_id").isNotNull() & R.active_or_deceased("p_active", "p_deceased"))
    flags = t.dwh_partners.select(
        F.col("partner_id").alias("w_id"), "vrijwilliger", "bestuurder", "conservator", "aankoper"
    )
    joined = spans.join(pdim, F.col("partner_id") == F.col("p_id"), "inner").join(
        flags, F.col("p_id") == F.col("w_id"), "inner"
    )
    out = joined.select(
        "partner_id", "bedrag", "project_code", "project", "periode_j", "periode_m", "r",
        F.col("p_first_name").alias("voornaam"),
        F.col("p_last_name").alias("achternaam"),
        P.straat().alias("straat"),
        P.huisnummer().alias("huisnummer"),
        F.col("p_street_bus").alias("bus"),
        P.postcode().alias("postcode"),
        P.gemeente().alias("gemeente"),
        F.col("p_postbus_nbr").alias("postbus"),
        F.col("c_name").alias("land"),
        F.col("p_email").alias("email"),
        F.col("p_email_work").alias("email_work"),
        "vrijwilliger", "bestuurder", "conservator", "aankoper",
        P.email_ontvangen().alias("email_ontvangen"),
        P.post_ontvangen().alias("post_ontvangen"),
        F.col("p_iets_te_verbergen").alias("iets_te_verbergen"),
        P.overleden().alias("overleden"),
    )
    return out.orderBy(F.col("r").desc_nulls_first(), "partner_id", "project_code")
