"""Tax-certificate lists.

* ``certificate_lines`` / ``fiscal_certificates``: gifts on the certificate
  account and the per-donor, per-entity certificate totals (>= EUR 40).
* ``annualised_pledges`` / ``certificate_donors_missing_id``: donors expected
  to reach EUR 40 this year (year-to-date gifts, standing direct-debit
  orders annualised, recurring project donors, regular donors from the
  profile) who want a certificate but have no national id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.period import as_date, months_before, resolve_period
from ..plans import partner as P
from ..plans.joins import lookup
from ..plans.ledger import GiftLedger
from .profile import donor_profile
from .recurring import donor_spans

CERTIFICATE_MINIMUM = 40
TOTAL = "decimal(18,2)"


# ---------------------------------------------------------------- from ledger
def certificate_lines(ledger: GiftLedger) -> DataFrame:
    """Ledger gifts on the certificate account, except the 2014 migration."""
    wide = ledger.wide()
    return wide.where(
        (F.col("grootboekrek") == R.CERTIFICATE_ACCOUNT) & ~F.col("description").like("GIFT/2014/%")
    )


CERTIFICATE_PARTNER_KEYS = [
    "partner_id", "geboorte_datum", "rechtspersoon", "aanspreking", "geslacht", "naam", "achternaam", "voornaam",
    "naam_partner", "straat", "huisnummer", "bus", "postcode", "gemeente", "land", "adres_status",
    "email_ontvangen", "post_ontvangen", "overleden",
]


def certificate_lines_total(ledger: GiftLedger) -> DataFrame:
    """Total of ``certificate_lines`` (one row, NULL without lines)."""
    cond = (F.col("grootboekrek") == R.CERTIFICATE_ACCOUNT) & ~F.col("description").like("GIFT/2014/%")
    agg = ledger.aggregate([], [], {"s": F.sum("amount")}, {"s": F.sum("s")}, fact_filter=cond)
    return agg.select(F.col("s").cast(TOTAL).alias("bedrag"))


def fiscal_certificates(ledger: GiftLedger, minimum: int = CERTIFICATE_MINIMUM, entity_pattern: str | None = None,
                        donor_not_like: tuple[str, ...] = (), partner_ids: tuple[int, ...] = ()) -> DataFrame:
    """Per donor and legal entity: certificate gifts (credit - debit) >= minimum;
    optionally of the entities, and without the donors, whose lower-cased name
    is like the given patterns, or of a list of partners."""
    gift = F.col("grootboekrek") == R.CERTIFICATE_ACCOUNT
    if partner_ids:
        gift = gift & F.col("partner_id").isin(*partner_ids)
    if entity_pattern is not None:
        gift = gift & F.lower("vzw").like(entity_pattern)
    donor = None
    for pattern in donor_not_like:
        other = ~F.lower("naam").like(pattern)
        donor = other if donor is None else donor & other
    agg = ledger.aggregate(
        fact_keys=["vzw"],
        partner_keys=CERTIFICATE_PARTNER_KEYS,
        partials={"sc": F.sum("credit"), "sd": F.sum("debet")},
        finals={"sc": F.sum("sc"), "sd": F.sum("sd")},
        fact_filter=gift,
        partner_filter=donor,
    )
    amount = (F.col("sc") - F.col("sd")).cast(TOTAL)
    out = agg.select(
        "partner_id", "geboorte_datum", F.col("rechtspersoon").alias("aard_vd_schenker"), "aanspreking",
        "geslacht", "naam", "achternaam", "voornaam", "naam_partner", "straat", "huisnummer", "bus", "postcode",
        F.col("gemeente").alias("woonplaats"), "land", amount.alias("amount"),
        F.lit(None).cast("string").alias("nr"), "adres_status", "email_ontvangen", "post_ontvangen", "overleden",
        "vzw",
    )
    return out.where(F.col("amount") >= minimum)


def fiscal_certificates_total(ledger: GiftLedger, **options) -> DataFrame:
    """Total of ``fiscal_certificates`` (one row, NULL without certificates)."""
    return fiscal_certificates(ledger, **options).agg(F.sum("amount").cast(TOTAL).alias("bedrag"))


# ---------------------------------------------------------------- pledges
def _valid_mandates(t, dedupe: bool = False) -> DataFrame:
    """Number of valid direct-debit mandates per partner.  In the report each
    mandate repeats the partner's orders, so it multiplies the sum; with
    ``dedupe`` every partner with a valid mandate counts once."""
    banks = t.res_partner_bank.select(F.col("id").alias("pb_id"), F.col("partner_id").alias("m_partner"))
    mandates = t.sdd_mandate.where(F.col("state") == "valid").select(F.col("partner_bank_id").alias("sm_bank"))
    counted = (
        banks.join(mandates, F.col("pb_id") == F.col("sm_bank"), "inner")
        .groupBy("m_partner")
        .agg(F.count(F.lit(1)).alias("mandates"))
    )
    return counted.select("m_partner", F.lit(1).cast("bigint").alias("mandates")) if dedupe else counted


def annualised_pledges(t, as_of, dedupe_mandates: bool = False) -> DataFrame:
    """Standing orders of active partners, not cancelled on ``as_of``:
    yearly amounts as they are, monthly amounts times 12."""
    day = as_date(as_of)
    active = t.res_partner.where(F.col("active") == F.lit(True)).select(F.col("id").alias("a_id"))
    orders = t.donation_partner_account.where(
        F.col("interval_type").isin("J", "M") & R.not_cancelled("donation_cancel", day)
    )
    orders = orders.join(active, F.col("partner_id") == F.col("a_id"), "left_semi")
    orders = orders.join(_valid_mandates(t, dedupe_mandates), F.col("partner_id") == F.col("m_partner"), "inner")
    per = orders.groupBy("partner_id", "interval_type").agg(
        F.sum(F.col("donation_amount") * F.col("mandates")).alias("s")
    )
    factor = F.when(F.col("interval_type") == "M", F.lit(12)).otherwise(F.lit(1))
    return per.select(
        "partner_id",
        F.col("interval_type").alias("soort"),
        (F.col("s") * factor).cast(TOTAL).alias("bedrag"),
    )


def _year_totals(t, start, end, history_start) -> DataFrame:
    """Per partner: year-to-date gifts of private donors (booked gifts of an
    existing partner, payment history of a partner with a known country) plus
    the totals of the projects supported regularly, from one fold of the gifts."""
    country = t.res_country.select(F.col("id").alias("c_id"))
    partners = lookup(t.res_partner, country, F.col("country_id") == F.col("c_id"), "left").select(
        F.col("id").alias("k_id"),
        F.col("c_id").isNotNull().alias("known"),
        (F.coalesce(F.col("organisation_type_id"), F.lit(0)) == 0).alias("private"),
        R.active_or_deceased("active", "deceased").alias("eligible"),
    )
    listed = t.dwh_partners.groupBy(F.col("partner_id").alias("w_id")).agg(F.count(F.lit(1)).alias("listed"))
    spans = donor_spans(t, start, end, history_start).groupBy("partner_id").agg(
        F.sum("booked_window").alias("booked"),
        F.sum("history_window").alias("history"),
        F.sum(F.when(F.col("regular"), F.col("bedrag"))).alias("regular"),
    )
    joined = spans.join(partners, F.col("partner_id") == F.col("k_id"), "inner").join(
        listed, F.col("partner_id") == F.col("w_id"), "left")
    parts = [
        F.when(F.col("private") & (F.col("partner_id") > 0), F.col("booked")),
        F.when(F.col("private") & F.col("known"), F.col("history")),
        F.when(F.col("eligible") & F.col("known"), F.col("regular") * F.col("listed")),
    ]
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return joined.where(F.coalesce(*parts).isNotNull()).select("partner_id", total.cast(TOTAL).alias("bedrag"))


def certificate_donors_missing_id(
    t, as_of, profile_since_year: int | None = None, history_months: int = 13,
    minimum: int = CERTIFICATE_MINIMUM, dedupe_mandates: bool = False, profile: DataFrame | None = None,
) -> DataFrame:
    """``profile``: the donor profiles, if they are stored; then the booked
    lines are read once, for the months of the fold."""
    day = as_date(as_of)
    start, end = resolve_period("YTD", as_of=day)
    since = day.year - 1 if profile_since_year is None else profile_since_year
    year = _year_totals(t, start, end, months_before(day, history_months))
    pledges = annualised_pledges(t, day, dedupe_mandates).select("partner_id", "bedrag")
    staged = (
        year.unionByName(pledges)
        .groupBy("partner_id").agg(F.sum("bedrag").cast("double").alias("bedrag"))
    )
    regular = (donor_profile(t) if profile is None else profile).where(
        (F.col("jaarlaatstegift") >= since) & (F.col("jarendonateur") >= 2) & (F.col("avggiftenperjaar") >= 0.75)
    ).select("partner_id", F.col("avgbedragperjaar").alias("bedrag"))
    staged = staged.unionByName(regular).where(F.col("bedrag") >= minimum)
    totals = staged.groupBy("partner_id").agg(F.sum("bedrag").alias("bedrag"))

    pdim = P.partner_dim(t, ("country", "street", "city")).where(
        F.col("c_id").isNotNull()
        & (F.coalesce(F.col("p_national_id_nbr"), F.lit("_")) == "_")
        & (F.col("p_tax_certificate") == F.lit(True))
        & (F.coalesce(F.col("p_organisation_type_id"), F.lit(0)) == 0)
    )
    reg = R.uses_register("c_id", "p_crab_used")
    joined = totals.join(pdim, F.col("partner_id") == F.col("p_id"), "inner")
    return joined.select(
        "partner_id",
        "bedrag",
        R.or_empty("p_first_name").alias("voornaam"),
        R.or_empty("p_last_name").alias("achternaam"),
        F.col("p_corporation_type_id").alias("corporation_type_id"),
        F.when(reg, R.or_empty("ccs_name")).otherwise(R.or_empty("p_street")).alias("straat"),
        F.when(reg, R.or_empty("p_street_nbr")).otherwise(F.lit("")).alias("huisnummer"),
        R.or_empty("p_street_bus").alias("bus"),
        F.when(reg, R.or_empty("cc_zip")).otherwise(R.or_empty("p_zip")).alias("postcode"),
        F.when(F.col("c_id") == R.BELGIUM, R.or_empty("cc_name")).otherwise(R.or_empty("p_city")).alias("woonplaats"),
        F.col("c_name").alias("land"),
        F.coalesce(F.col("p_email"), F.col("p_email_work"), F.lit("")).alias("email"),
        R.or_empty("p_national_id_nbr").alias("rrn"),
        R.or_empty("p_company_registration_number").alias("on_nr"),
        F.col("p_tax_certificate").alias("tax_certificate"),
    )
