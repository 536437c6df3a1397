"""Direct-debit donation orders (standing orders with a bank mandate)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

TOTAL = "decimal(18,2)"


def _with_mandate(t) -> DataFrame:
    """Partner ids that hold a bank account with a direct-debit mandate."""
    banks = t.res_partner_bank.select(F.col("id").alias("pb_id"), F.col("partner_id").alias("m_partner"))
    mandates = t.sdd_mandate.select(F.col("partner_bank_id").alias("sm_bank"))
    return banks.join(mandates, F.col("pb_id") == F.col("sm_bank"), "left_semi").select("m_partner")


def _orders_of_partners(t, partner_filter=None) -> DataFrame:
    partners = t.res_partner
    if partner_filter is not None:
        partners = partners.where(partner_filter)
    partners = partners.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"))
    orders = t.donation_partner_account.join(partners, F.col("partner_id") == F.col("p_id"), "inner")
    # the mandate join only filters: DISTINCT over the order columns removes
    # the repetition per mandate, so a semi join gives the same rows
    return orders.join(_with_mandate(t), F.col("partner_id") == F.col("m_partner"), "left_semi")


def _last_invoices(t, by_invoice: bool = False) -> DataFrame:
    keys = ["partner_id", "amount_total"] + (["invoice_id"] if by_invoice else [])
    return t.donation_donation_line.groupBy(*keys).agg(F.max("date_invoice").alias("aanmaak_factuur")).select(
        F.col("partner_id").alias("ddl_partner"),
        F.col("amount_total"),
        F.col("aanmaak_factuur"),
        *([F.col("invoice_id")] if by_invoice else []),
    )


def _join_invoices(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    # (partner, amount) pairs: the latest invoice of the order's own amount
    return orders.join(
        invoices,
        (F.col("partner_id") == F.col("ddl_partner")) & (F.col("donation_amount") == F.col("amount_total")),
        "left",
    )


def yearly_orders_overview(
    t,
    interval_type: str = "J",
    next_after: str = "2021-01-01",
    cancelled_on: str | None = None,
    negative_only: bool = False,
    active_only: bool = True,
) -> DataFrame:
    """Orders of partners with a mandate and the date of the last invoice of
    the same amount; by default yearly orders of active partners that were
    never cancelled and are due after ``next_after``.  ``cancelled_on``
    switches to "not cancelled on that day"; ``negative_only`` lists refund
    orders; ``active_only=False`` drops the active-partner condition."""
    partner_filter = F.col("active") == F.lit(True) if active_only else None
    orders = _orders_of_partners(t, partner_filter).where(F.col("interval_type") == interval_type)
    if cancelled_on is None:
        orders = orders.where(R.never_cancelled("donation_cancel"))
    else:
        orders = orders.where(R.not_cancelled("donation_cancel", cancelled_on))
    orders = orders.where(
        F.coalesce(F.col("next_invoice_date"), F.lit(next_after).cast("date")) > F.lit(next_after).cast("date")
    )
    if negative_only:
        orders = orders.where(F.col("donation_amount") < 0)
    return _overview(t, orders)


def _overview(t, orders: DataFrame) -> DataFrame:
    out = _join_invoices(orders, _last_invoices(t)).select(
        "id", "partner_id", "analytic_account_id", F.col("p_name").alias("name"), "interval_type",
        "interval_number", F.col("donation_amount").alias("bedrag"), "next_invoice_date", "donation_start",
        "last_invoice_date", "donation_cancel", "aanmaak_factuur", "amount_total",
    )
    # orders without an invoice share one date: the order id spreads them over the sort's ranges
    return out.orderBy(F.col("aanmaak_factuur").asc_nulls_last(), "id")


def orders_due(t, day, interval_type: str = "M") -> DataFrame:
    """Orders of one interval due or starting on ``day``, in the overview's columns."""
    d = F.lit(day).cast("date")
    orders = _orders_of_partners(t).where(
        (F.col("interval_type") == interval_type) & ((F.col("next_invoice_date") == d) | (F.col("donation_start") == d)))
    return _overview(t, orders)


def next_invoice_dates(t, interval_type: str = "J") -> DataFrame:
    """Distinct next invoice dates of the orders with a mandate."""
    orders = _orders_of_partners(t).where(F.col("interval_type") == interval_type)
    return orders.select("next_invoice_date").distinct()


def orders_by_date(t, day) -> DataFrame:
    """Orders due or starting on ``day``, with every invoice of the same amount."""
    d = F.lit(day).cast("date")
    orders = _orders_of_partners(t).where((F.col("next_invoice_date") == d) | (F.col("donation_start") == d))
    out = _join_invoices(orders, _last_invoices(t, by_invoice=True)).select(
        F.col("partner_id").alias("id"), F.col("p_name").alias("name"), "interval_type", "interval_number",
        F.col("donation_amount").alias("bedrag"), "invoice_id", "next_invoice_date", "last_invoice_date",
        "donation_cancel", "aanmaak_factuur", "amount_total",
    )
    return out.distinct()


def latest_invoices(t, n: int = 100) -> DataFrame:
    """The ``n`` most recent invoiced donation lines (newest first, lines
    without a date before them, as descending order puts NULL first; equal
    dates by invoice number).  A distributed top-n: each partition keeps its
    own best ``n`` before the merge, nothing else reaches one task."""
    lines = t.donation_donation_line
    return lines.orderBy(
        F.col("date_invoice").desc_nulls_first(), F.col("invoice_id").desc_nulls_first()
    ).limit(n)
