"""Gift categories: every gift of a period with its processing status, donor
class, amount band and single-/repeat-gift class.

Booked lines (gift and suspense accounts) UNION draft bank-statement lines,
whole rows de-duplicated.  Two plan choices keep this cheap at scale:

* The lifetime gift count per partner comes from ``donor_profile`` computed
  once for all partners and left-joined on the partner, instead of one
  profile evaluation per gift.
* The de-duplication runs on the gift columns *plus* the partner id before
  the partner columns are attached: every partner column is a function of
  the partner id, so equal enriched rows are exactly equal narrow rows, and
  the shuffle for DISTINCT carries narrow rows spread over all columns (a
  hot partner does not concentrate in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.period import resolve_period
from ..plans import partner as P
from ..plans.joins import left_join_spread_nulls
from ..plans.facts import draft_lines, posted_lines, project_code, project_name
from .profile import donor_profile

CATEGORY_ACCOUNTS = ("732000", "732100", "499010")
AMOUNT = "decimal(16,2)"


def _dims() -> list:
    return [
        R.or_empty("d1_name").alias("dimensie1"),
        R.or_empty("d2_name").alias("dimensie2"),
        R.or_empty("d3_name").alias("dimensie3"),
        R.or_empty("d1_code").alias("code1"),
        R.or_empty("d2_code").alias("code2"),
        R.or_empty("d3_code").alias("code3"),
        project_code().alias("project_code"),
        project_name().alias("project"),
    ]


def _posted(t, start, end) -> DataFrame:
    lines = posted_lines(t, start, end, CATEGORY_ACCOUNTS)
    amount = R.gift_amount().cast(AMOUNT)
    return lines.select(
        F.col("partner_id"),
        F.col("date").alias("datum"),
        R.processing_status("aa_code", posted=True).alias("giftcatverwerkt"),
        R.amount_band(amount).alias("giftcatbedrag"),
        amount.alias("bedrag"),
        R.clean_text("name").alias("description"),
        *_dims(),
        F.col("aa_code").alias("grootboekrek"),
        F.col("am_name").alias("boeking"),
        R.posting_type("am_name").alias("boeking_type"),
        F.col("rc_name").alias("vzw"),
    )


def _draft(t, start, end) -> DataFrame:
    lines = draft_lines(t, start, end, CATEGORY_ACCOUNTS)
    amount = F.col("amount").cast(AMOUNT)
    none = F.lit(None).cast("string")
    return lines.select(
        F.col("partner_id"),
        F.col("date").alias("datum"),
        R.processing_status("aa_code", posted=False).alias("giftcatverwerkt"),
        R.amount_band(amount).alias("giftcatbedrag"),
        amount.alias("bedrag"),
        R.clean_text("name").alias("description"),
        *_dims(),
        none.alias("grootboekrek"),
        none.alias("boeking"),
        none.alias("boeking_type"),
        none.alias("vzw"),
    )


def _enrich(t, gifts: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """De-duplicate narrow gifts and attach the partner columns.

    A partner id without a partner row reports as "no partner", like a
    missing id; both can make two gifts equal, so the ids are resolved before
    the one DISTINCT.  Gifts without partner are dealt over all tasks of both
    joins; a hot partner is split by adaptive skew handling."""
    known = t.res_partner.select(F.col("id").alias("known_id"))
    gifts = left_join_spread_nulls(gifts, known, "partner_id", "known_id")
    gifts = gifts.withColumn("partner_id", F.col("known_id")).drop("known_id").distinct()
    counts = (donor_profile(t) if profile is None else profile).select(F.col("partner_id").alias("pr_id"), "aantalgiften")
    pdim = P.partner_dim(t, ("country", "street", "city"))
    pdim = pdim.join(counts, F.col("p_id") == F.col("pr_id"), "left").drop("pr_id")
    return _project(left_join_spread_nulls(gifts, pdim, "partner_id", "p_id"))


def _project(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.col("p_id").alias("partner_id"),
        "datum",
        "giftcatverwerkt",
        R.gift_count_class("aantalgiften").alias("giftcataantal"),
        R.donor_class("p_organisation_type_id", "p_corporation_type_id").alias("giftcatdonateur"),
        "giftcatbedrag",
        "bedrag",
        "description",
        F.col("p_first_name").alias("voornaam"),
        F.col("p_last_name").alias("achternaam"),
        P.straat().alias("straat"),
        P.huisnummer().alias("huisnummer"),
        R.bus_prefixed("p_street_bus").alias("bus"),
        P.postcode().alias("postcode"),
        P.gemeente().alias("gemeente"),
        F.col("c_name").alias("land"),
        P.adres_status().alias("adres_status"),
        P.email_ontvangen().alias("email_ontvangen"),
        P.post_ontvangen().alias("post_ontvangen"),
        F.col("p_email").alias("email"),
        R.phone_number("p_mobile", "p_phone").alias("telefoonnr"),
        "dimensie1", "dimensie2", "dimensie3", "code1", "code2", "code3", "project_code", "project",
        "grootboekrek", "boeking", "boeking_type", "vzw",
    )


def categories_between(t, first, last, profile: DataFrame | None = None) -> DataFrame:
    """Gift categories of [first, last]; None: no border.  ``profile``: the
    donor profiles, if they are stored."""
    return _enrich(t, _posted(t, first, last).unionByName(_draft(t, first, last)), profile)


def gift_categories(t, period: str, start=None, end=None, as_of=None, profile: DataFrame | None = None) -> DataFrame:
    return categories_between(t, *resolve_period(period, start, end, as_of), profile)


def draft_statement_gifts(t, period: str, start=None, end=None, as_of=None) -> DataFrame:
    first, last = resolve_period(period, start, end, as_of)
    return _enrich(t, _draft(t, first, last))
