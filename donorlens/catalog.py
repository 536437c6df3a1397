"""Registered report runs: name -> callable(spark, sf_dir) -> DataFrame.

Each run maps the driver tables onto the ERP schema and evaluates one
report over the whole tables with the parameters of ``params``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params as Q
from .functions import rules as R
from .operators import categories as CAT
from .operators import certificates as CERT
from .operators import orders as ORD
from .operators import recurring as REC
from .operators import trace as TR
from .operators import extracts as X
from .operators import ledger_reports as LR
from .plans.ledger import gift_ledger
from .plans.selection import Selection
from .operators import profile as PRO
from .plans.store import LedgerStore, ProfileStore
from .session import checkpoint_dir
from .sources import TestdataTables
from .sources.sinks import export_ordered, read_ordered
from .sql_functions import register_functions

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str) -> TestdataTables:
    from .session import configure

    configure(spark)
    return TestdataTables.for_session(spark, sf_dir)


def _q(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_tables(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _l(fn) -> Query:
    """A report over the analyst ledger of the default period."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _tables(spark, sf_dir)
        return fn(gift_ledger(t, Q.LEDGER_START, Q.LEDGER_END), t)

    return run


def _sql(text: str) -> Query:
    """A call of the SQL table functions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _tables(spark, sf_dir)
        register_functions(spark, t)
        t.newsletter.createOrReplaceTempView("newsletter")
        return spark.sql(text)

    return run


def _ledger_store(t) -> LedgerStore:
    """The ledger of the default period, loaded in two overlapping parts; once per session and folder."""

    def build() -> LedgerStore:
        store = LedgerStore(t.spark, buckets=Q.STORE_BUCKETS, hot_rows=Q.STORE_HOT_ROWS)
        for start, end in Q.STORE_LOADS:
            store.load(t, start, end)
        return store

    return t.memo("ledger_store", build)


def _stored(fn) -> Query:
    """A report over the stored ledger."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _tables(spark, sf_dir)
        return fn(_ledger_store(t).ledger(Q.LEDGER_START, Q.LEDGER_END), t)

    return run


def _stored_profile(t) -> DataFrame:
    def build() -> ProfileStore:
        store = ProfileStore(t.spark)
        for first, last in Q.PROFILE_YEAR_LOADS:
            store.load(t, first, last)
        return store

    return PRO.donor_profile(t, parts=t.memo("profile_store", build).partials())


def _exported_donors(g, t) -> DataFrame:
    """Thank-you totals exported in order and read back with their place."""
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/exports/donors-{uuid.uuid4().hex}"
    donors = LR.thankyou_totals(g, Q.THANKYOU_PATTERN)
    export_ordered(donors, path, [F.col("bedrag").desc(), "partner_id"], rows_per_file=50)
    return read_ordered(t.spark, path, ", ".join(f"{c} {kind}" for c, kind in donors.dtypes))


QUERIES: dict[str, Query] = {
    "gift_ledger": _q(lambda t: X.gift_ledger(t, Q.LEDGER_START, Q.LEDGER_END)),
    "gift_ledger_one_partner": _q(lambda t: X.gift_ledger(t, Q.LEDGER_START, Q.LEDGER_END, Q.ONE_PARTNER)),
    "marketing_income": _q(
        lambda t: X.marketing_income(t, Q.MARKETING_PERIOD, Q.MARKETING_START, Q.MARKETING_END)
    ),
    "gift_ledger_extract": _q(lambda t: X.ledger_extract(t, Q.LEDGER_START, Q.LEDGER_END)),
    "inactive_duplicate_gifts": _q(lambda t: X.ledger_branch(t, Q.LEDGER_START, Q.LEDGER_END, "moved")),
    "history_gifts": _q(lambda t: X.ledger_branch(t, Q.LEDGER_START, Q.LEDGER_END, "history")),
    "legacy_ledger": _q(lambda t: X.legacy_ledger(t, Q.LEGACY_START, Q.LEGACY_END)),
    "donor_profile": _q(PRO.donor_profile),
    "gift_categories": _q(lambda t: CAT.gift_categories(t, Q.CATEGORY_PERIOD, as_of=Q.CATEGORY_AS_OF)),
    "draft_statement_gifts": _q(lambda t: CAT.draft_statement_gifts(t, Q.CATEGORY_PERIOD, as_of=Q.CATEGORY_AS_OF)),
    "recurring_project_donors": _q(
        lambda t: REC.recurring_project_donors(t, Q.RECURRING_START, Q.RECURRING_END, Q.RECURRING_HISTORY_START)
    ),
    "annualised_pledges": _q(lambda t: CERT.annualised_pledges(t, Q.CERTIFICATE_AS_OF)),
    "certificate_donors_missing_id": _q(
        lambda t: CERT.certificate_donors_missing_id(
            t, Q.CERTIFICATE_AS_OF, Q.CERTIFICATE_PROFILE_SINCE, Q.CERTIFICATE_HISTORY_MONTHS
        )
    ),
    "yearly_orders_overview": _q(lambda t: ORD.yearly_orders_overview(t, "J", Q.ORDERS_NEXT_AFTER)),
    "next_invoice_dates": _q(lambda t: ORD.next_invoice_dates(t, "J")),
    "orders_by_date": _q(lambda t: ORD.orders_by_date(t, Q.ORDERS_ON_DATE)),
    "gift_statistics": _l(lambda g, t: LR.gift_statistics(g)),
    "certificate_lines": _l(lambda g, t: CERT.certificate_lines(g)),
    "fiscal_certificates": _l(lambda g, t: CERT.fiscal_certificates(g)),
    "unique_donors": _l(lambda g, t: LR.unique_donors(g)),
    "project_totals_since": _l(
        lambda g, t: LR.project_totals_since(g, Q.PROJECT_TOTALS_PATTERN, Q.PROJECT_TOTALS_SINCE)
    ),
    "donor_contact_flags": _l(lambda g, t: LR.donor_contact_flags(g, t)),
    "thankyou_totals": _l(lambda g, t: LR.thankyou_totals(g, Q.THANKYOU_PATTERN)),
    "thankyou_post": _l(lambda g, t: LR.thankyou_post(g)),
    "thankyou_region": _l(lambda g, t: LR.thankyou_region(g)),
    "project_totals": _l(lambda g, t: LR.project_totals(g)),
    "provider_gifts": _l(lambda g, t: LR.provider_gifts(g, Q.PROVIDER_PATTERN)),
    "ledger_lookup": _l(lambda g, t: LR.ledger_lookup(g, partner_id=Q.LOOKUP_PARTNER)),
    "profile_enrichment": _l(lambda g, t: LR.profile_enrichment(g, t)),
    "posting_trace": _q(TR.posting_trace),
    "monthly_orders_overview": _q(
        lambda t: ORD.yearly_orders_overview(
            t, "M", Q.MONTHLY_ORDERS_NEXT_AFTER, cancelled_on=Q.MONTHLY_ORDERS_AS_OF, active_only=False
        )
    ),
    "latest_invoices": _q(lambda t: ORD.latest_invoices(t, Q.LATEST_INVOICES)),
    "ledger_dates": _l(lambda g, t: LR.ledger_dates(g, "npca")),
    "legacy_history": _q(lambda t: X.legacy_history(t, Q.LEGACY_START, Q.LEGACY_END)),
    "legacy_ledger_wide": _q(lambda t: X.legacy_ledger(t, Q.LEGACY_START, Q.LEGACY_END, wide=True)),
    "legacy_history_wide": _q(lambda t: X.legacy_history(t, Q.LEGACY_START, Q.LEGACY_END, wide=True)),
    "unique_donors_by_place": _l(
        lambda g, t: LR.unique_donors(g, Selection(postcodes=Q.DONOR_POSTCODES, account=R.CERTIFICATE_ACCOUNT))
    ),
    "unique_donors_by_gift": _l(
        lambda g, t: LR.unique_donors(g, Selection(
            provinces=Q.DONOR_PROVINCES, code_pattern=Q.PROJECT_TOTALS_PATTERN, description_like=Q.DONOR_DESCRIPTIONS))
    ),
    "thankyou_post_selected": _l(
        lambda g, t: LR.thankyou_post(g, Selection(
            code_pattern=Q.THANKYOU_PATTERN, with_email=False, description_not_like=Q.DESCRIPTION_LEFT_OUT))
    ),
    "thankyou_mail": _l(
        lambda g, t: LR.thankyou_region(g, Selection(
            codes=Q.MAIL_CODES, with_email=True, accepts_email=True, description_not_like=Q.DESCRIPTION_LEFT_OUT))
    ),
    "partner_totals_since": _l(
        lambda g, t: LR.project_totals_since(g, Q.PROJECT_TOTALS_PATTERN, Q.PROJECT_TOTALS_SINCE, by="partner_id")
    ),
    "provider_gifts_other": _l(lambda g, t: LR.provider_gifts(g, Q.PROVIDER_OTHER_PATTERN, exclusions=())),
    "ledger_lookup_text": _l(
        lambda g, t: LR.ledger_lookup(g, selection=Selection(description_like=Q.LOOKUP_DESCRIPTION), order_by="naam")
    ),
    "ledger_lookup_department": _l(
        lambda g, t: LR.ledger_lookup(g, selection=Selection(
            department_like=Q.LOOKUP_DEPARTMENT, project_pattern=Q.LOOKUP_PROJECT))
    ),
    "ledger_lookup_dates": _l(
        lambda g, t: LR.ledger_lookup(g, selection=Selection(dates=Q.LOOKUP_DATES, source="ERP"))
    ),
    "certificate_lines_total": _l(lambda g, t: CERT.certificate_lines_total(g)),
    "fiscal_certificates_total": _l(lambda g, t: CERT.fiscal_certificates_total(g)),
    "fiscal_certificates_of_entity": _l(
        lambda g, t: CERT.fiscal_certificates(
            g, entity_pattern=Q.CERTIFICATE_ENTITY, donor_not_like=Q.CERTIFICATE_NOT_DONOR)
    ),
    "orders_due": _q(lambda t: ORD.orders_due(t, Q.ORDERS_DUE_ON)),
    "refund_orders": _q(lambda t: ORD.yearly_orders_overview(t, "J", Q.ORDERS_NEXT_AFTER, negative_only=True)),
    "posting_lines": _q(lambda t: TR.posting_lines(t, Q.TRACE_NAMES)),
    "posting_analytic_lines": _q(lambda t: TR.posting_analytic_lines(t, Q.TRACE_NAMES, Q.TRACE_ACCOUNTS)),
    "posting_trace_named": _q(lambda t: TR.posting_trace(t, Q.TRACE_NAMES)),
    "fiscal_certificates_of_partners": _l(lambda g, t: CERT.fiscal_certificates(g, partner_ids=Q.CERTIFICATE_PARTNERS)),
    "gift_ledger_function": _sql(f"SELECT * FROM gift_ledger(NULL, DATE '{Q.LEDGER_START}', DATE '{Q.LEDGER_END}')"),
    "gift_ledger_function_one_partner": _sql(
        f"SELECT * FROM gift_ledger({Q.ONE_PARTNER}, DATE '{Q.LEDGER_START}', DATE '{Q.LEDGER_END}')"),
    "gift_categories_function": _sql(f"SELECT * FROM gift_categories('{Q.CATEGORY_PERIOD}', DATE '{Q.CATEGORY_AS_OF}')"),
    "donor_profile_function": _sql("SELECT p.* FROM newsletter AS n, LATERAL donor_profile(n.partner_id) AS p"),
    "marketing_income_function": _sql(
        f"SELECT * FROM marketing_income('{Q.MARKETING_PERIOD}', DATE '{Q.MARKETING_START}', DATE '{Q.MARKETING_END}')"),
    "donor_profile_stored": _q(_stored_profile),
    "gift_categories_stored": _q(
        lambda t: CAT.gift_categories(t, Q.CATEGORY_PERIOD, as_of=Q.CATEGORY_AS_OF, profile=_stored_profile(t))),
    "certificate_donors_stored": _q(
        lambda t: CERT.certificate_donors_missing_id(
            t, Q.CERTIFICATE_AS_OF, Q.CERTIFICATE_PROFILE_SINCE, Q.CERTIFICATE_HISTORY_MONTHS, profile=_stored_profile(t))),
    "ledger_extract_stored": _stored(lambda g, t: g.wide()),
    "gift_statistics_stored": _stored(lambda g, t: LR.gift_statistics(g)),
    "unique_donors_stored": _stored(lambda g, t: LR.unique_donors(g)),
    "ledger_lookup_stored": _stored(lambda g, t: LR.ledger_lookup(g, partner_id=Q.LOOKUP_PARTNER)),
    "exported_donors": _l(_exported_donors),
}


def register_views(spark: SparkSession, sf_dir: str, names=None, prefix: str = "") -> list[str]:
    """Expose registered reports as temporary views, so they can be queried
    from Spark SQL like the table functions they replace
    (``SELECT ... FROM gift_ledger WHERE ...``; the outer predicates are
    pushed into the report's plan by the optimizer)."""
    done = []
    for name in names or QUERIES:
        QUERIES[name](spark, sf_dir).createOrReplaceTempView(prefix + name)
        done.append(prefix + name)
    return done
