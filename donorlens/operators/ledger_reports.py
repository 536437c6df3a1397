"""Reports over the analyst ledger: statistics, donor and mailing lists,
project totals, look-ups and enrichment.

Every grouped report runs through ``GiftLedger.aggregate``: gifts are folded
per partner before partner attributes are attached, so the shuffles carry
partial rows, not gifts, and a hot donor is pre-aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..plans.ledger import ACTIVE, EXTRACT_COLUMNS, PARTNER_COLUMNS, GiftLedger
from ..plans.selection import DONOR_COLUMNS, EVERYTHING, Selection
from .profile import donor_profile

TOTAL = "decimal(18,2)"

# --------------------------------------------------------------------------
# Fixed values of the reports.
# --------------------------------------------------------------------------
# Project name folded together in the statistics (any case, outer spaces).
FOLDED_PROJECT = "Bos voor iedereen"
# Postcodes of the regional thank-you mailing, as listed in the report.
REGION_POSTCODES = (
    "8870", "2690", "8691", "8600", "8950", "8951", "8952", "8953", "8954", "8956", "8650", "8958", "8900",
    "8902", "8904", "8906", "8908", "8920", "8647", "8957", "8770", "8970", "8972", "8978", "8640", "8940",
    "8980", "8660", "8620", "8670", "8560", "8540", "8970", "8971", "8972", "8973", "8930", "8880", "8860",
    "8800", "8520", "8530", "8531",
)
# Payment-provider transaction text: prefixes removed from the cleaned key,
# and the short codes that exclude a line (with and without the space).
PROVIDER_KEY_REMOVALS = ("mangopaysanpdonation", "koalect")
PROVIDER_EXCLUSIONS = ("saf", "sa f", "salim", "sa lim", "saant", "sa ant", "saovl", "sa ovl", "sawvl", "sa wvl",
                       "sabra", "sa bra")

def _count_sums():
    return {"n": F.count("partner_id"), "sc": F.sum("credit"), "sd": F.sum("debet"),
            "sa": F.sum(F.col("credit") - F.col("debet"))}


def _merge_sums():
    return {"n": F.sum("n"), "sc": F.sum("sc"), "sd": F.sum("sd"), "sa": F.sum("sa")}


def _ratio(num, den):
    return F.try_divide(num.cast("double"), den.cast("double"))


# ---------------------------------------------------------------- statistics
STAT_KEYS = ("maand", "grootboekrek", "grootboekrek_naam", "afdeling", "vzw", "gemeente", "subproject")
# (category, grouping columns, subcategory column) of the stacked statistics
STAT_SETS = (
    ("Totaal", (), None),
    ("Per maand", ("maand",), "maand"),
    ("rekening", ("grootboekrek", "grootboekrek_naam"), "grootboekrek_naam"),
    ("afdeling", ("afdeling",), "afdeling"),
    ("vzw", ("vzw",), "vzw"),
    ("gemeente", ("gemeente",), "gemeente"),
    ("project", ("subproject",), "subproject"),
)


def _grouping_id(keys) -> int:
    n = len(STAT_KEYS)
    return sum(1 << (n - 1 - i) for i, c in enumerate(STAT_KEYS) if c not in keys)


def gift_statistics(ledger: GiftLedger) -> DataFrame:
    """Seven groupings stacked: total, per month, ledger account, department,
    legal entity, municipality and project (credit - debit, like the report,
    so payment-history rows count but add no money).

    The gifts are first folded per partner and fact keys (two-phase
    aggregate), then all seven groupings come from one GROUPING SETS
    aggregation over that small base: one extra shuffle instead of seven
    recomputations of the ledger."""
    folded = F.lower(F.trim(F.col("project")))
    subcat = F.when(folded == FOLDED_PROJECT.lower(), F.lit(FOLDED_PROJECT)).otherwise(F.col("project"))
    base = ledger.aggregate(
        fact_keys=["maand", "grootboekrek", "grootboekrek_naam", "vzw", "subproject"],
        partner_keys=["afdeling", "gemeente"],
        partials=_count_sums(),
        finals=_merge_sums(),
        fact_exprs={"subproject": subcat},
    )
    agg = base.groupingSets([list(keys) for _, keys, _ in STAT_SETS], *STAT_KEYS).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("sc").alias("sc"), F.sum("sd").alias("sd"),
        F.sum("sa").alias("sa"), F.grouping_id().alias("gid"),
    )
    category = None
    sub = None
    for name, keys, sub_col in STAT_SETS:
        cond = F.col("gid") == _grouping_id(keys)
        label = F.lit(name)
        value = F.lit("Totaal") if sub_col is None else (
            R.month_label("maand") if sub_col == "maand" else F.col(sub_col).cast("string"))
        category = F.when(cond, label) if category is None else category.when(cond, label)
        sub = F.when(cond, value) if sub is None else sub.when(cond, value)
    is_project = F.col("gid") == _grouping_id(("subproject",))
    bedrag = F.when(is_project, F.col("sa")).otherwise(F.col("sc") - F.col("sd"))
    return agg.select(
        category.alias("categorie"),
        sub.alias("subcategorie"),
        F.when(F.col("gid") == _grouping_id(("maand",)), F.col("maand")).cast("int").alias("maand"),
        F.col("n").cast("bigint").alias("aantal"),
        bedrag.cast(TOTAL).alias("bedrag"),
        _ratio(bedrag, F.col("n")).alias("gemiddelde"),
    )


# ---------------------------------------------------------------- donor lists
DONOR_KEYS = [
    "partner_id", "aanspreking", "geslacht", "naam", "voornaam", "achternaam", "straat", "huisnummer", "bus",
    "postcode", "gemeente", "provincie", "land", "email", "afdeling", "overleden", "adres_status",
    "post_ontvangen", "email_ontvangen", "nooit_contacteren", "lidnummer", "huidige_lidmaatschap_status",
]
def _date_sums():
    return {"s": F.sum("amount"), "d0": F.min("date"), "d1": F.max("date")}


def _date_merge():
    return {"s": F.sum("s"), "d0": F.min("d0"), "d1": F.max("d1")}


def unique_donors(ledger: GiftLedger, selection: Selection = Selection(accepts_post=True)) -> DataFrame:
    """Per donor and year: total and first/last gift date, by default of donors
    that may be written to (alive, address valid, post allowed, not hidden)."""
    agg = ledger.aggregate(["jaar"], DONOR_KEYS, _date_sums(), _date_merge(), fact_filter=selection.gift(), partner_filter=selection.donor())
    out = agg.select(
        "partner_id", F.col("s").cast(TOTAL).alias("bedrag"), "jaar", F.col("d0").alias("min_date"),
        F.col("d1").alias("max_date"), *DONOR_KEYS[1:],
    )
    return out.orderBy(F.col("partner_id").asc_nulls_last(), F.col("jaar").asc_nulls_last())


def project_totals_since(ledger: GiftLedger, code_pattern: str, since, by: str = "project") -> DataFrame:
    """Total per project (or per partner) of projects matching a code pattern
    from a given date on."""
    cond = F.col("project_code").like(code_pattern) & (F.col("date") >= F.lit(since).cast("date"))
    keys = [by] if by != "partner_id" else []
    agg = ledger.aggregate(keys, ["partner_id"] if by == "partner_id" else [], {"s": F.sum("amount")},
                           {"s": F.sum("s")}, fact_filter=cond)
    return agg.select(F.col("s").cast(TOTAL).alias("bedrag"), by)


EMPTY_SALTS = 256


def _address_key(address: str, salt) -> Column:
    """Lower-cased address; an empty one is a blank and a salt, which no address is."""
    return F.when(F.col(address) == "", F.concat(F.lit(" "), salt.cast("string"))).otherwise(F.lower(address))


def donor_contact_flags(ledger: GiftLedger, t) -> DataFrame:
    """Donors per year flagged as website user and as suppressed e-mail
    (case-insensitive match on the address).

    Both lists are left joins that repeat a gift as often as they hold its
    partner or address; every spelling of an address is a group of its own, and
    an empty address matches a listed empty one.  No row is repeated here: each
    list is folded to (key, spelling, how often) and the sums are multiplied."""
    web = t.website_users.groupBy(F.col("partner_id").alias("w_partner_id")).agg(F.count(F.lit(1)).alias("w_times"))
    spelled = t.suppression_list.where("emailaddress IS NOT NULL").groupBy(F.col("emailaddress").alias("s_emailaddress")).agg(
        F.count(F.lit(1)).alias("s_times"))
    # very many partners have no address: they, and the one listed empty address, are dealt over EMPTY_SALTS keys
    salts = F.when(F.col("s_emailaddress") == "", F.sequence(F.lit(0), F.lit(EMPTY_SALTS - 1))).otherwise(F.array(F.lit(0)))
    spelled = spelled.select("*", F.explode(salts).alias("salt")).select(
        _address_key("s_emailaddress", F.col("salt")).alias("s_key"), "s_emailaddress", "s_times")
    ext = ledger.partners(DONOR_KEYS).join(web, F.col("partner_id") == F.col("w_partner_id"), "left")
    ext = ext.withColumn("address", _address_key("email", F.pmod(F.xxhash64("partner_id"), F.lit(EMPTY_SALTS))))
    ext = ext.join(spelled, F.col("address") == F.col("s_key"), "left")
    keys = [*DONOR_KEYS, "w_partner_id", "s_emailaddress", "w_times", "s_times"]
    agg = ledger.aggregate(["jaar"], keys, _date_sums(), _date_merge(), partners=ext)
    times = F.coalesce("w_times", F.lit(1)) * F.coalesce("s_times", F.lit(1))
    out = agg.select(
        "partner_id", (F.col("s") * times).cast(TOTAL).alias("bedrag"), "jaar", F.col("d0").alias("min_date"),
        F.col("d1").alias("max_date"), "aanspreking", "geslacht", "naam", "voornaam", "achternaam", "straat",
        "huisnummer", "bus", "postcode", "gemeente", "provincie", "land", "email",
        R.found_flag("w_partner_id", 0).alias("website_gebruiker"),
        R.found_flag("s_emailaddress", "_").alias("suppressed"),
        "afdeling", "overleden", "adres_status", "post_ontvangen", "email_ontvangen", "nooit_contacteren",
        "lidnummer", "huidige_lidmaatschap_status",
    ).distinct()
    return out.orderBy(F.col("partner_id").asc_nulls_last(), F.col("jaar").asc_nulls_last())


# ---------------------------------------------------------------- thank-you lists
def _count_amount():
    return {"n": F.count("partner_id"), "s": F.sum("amount")}


def _merge_count_amount():
    return {"n": F.sum("n"), "s": F.sum("s")}


def thankyou_totals(ledger: GiftLedger, code_pattern: str) -> DataFrame:
    agg = ledger.aggregate([], ["partner_id", "naam"], _count_amount(), _merge_count_amount(),
                           fact_filter=F.col("project_code").like(code_pattern))
    return agg.select("partner_id", "naam", F.col("n").cast("bigint").alias("aantal"),
                      F.col("s").cast(TOTAL).alias("bedrag"))


MAILING_KEYS = [
    "partner_id", "naam", "voornaam", "achternaam", "straat", "huisnummer", "bus", "postcode", "gemeente",
    "provincie", "land", "email", "afdeling", "lidnummer", "huidige_lidmaatschap_status",
]


def thankyou_post(ledger: GiftLedger, selection: Selection = EVERYTHING) -> DataFrame:
    """Per donor and project, donors that may be written to, with the
    address line for the letter."""
    agg = ledger.aggregate(["project"], MAILING_KEYS, _count_amount(), _merge_count_amount(), fact_filter=selection.gift(),
                           partner_filter=selection.donor(R.contactable_by_post()), filter_columns=DONOR_COLUMNS)
    out = agg.select(
        "partner_id", F.col("n").cast("bigint").alias("aantal"), F.col("s").cast(TOTAL).alias("bedrag"), "project",
        "naam", "voornaam", "achternaam", R.mailing_line("straat", "huisnummer", "bus").alias("adres"),
        *MAILING_KEYS[4:],
    )
    return out.orderBy(F.col("partner_id").asc_nulls_last())


def thankyou_region(ledger: GiftLedger, selection: Selection = Selection(postcodes=REGION_POSTCODES)) -> DataFrame:
    """Per donor and year, living donors that are not hidden; by default those
    living in the region's postcodes."""
    status = ["overleden", "adres_status", "post_ontvangen", "email_ontvangen", "nooit_contacteren"]
    reachable = (F.col("overleden") == "false") & (F.coalesce(F.col("nooit_contacteren"), F.lit("false")) == "false")
    agg = ledger.aggregate(["jaar"], MAILING_KEYS + status, _count_amount(), _merge_count_amount(),
                           fact_filter=selection.gift(), partner_filter=selection.donor(reachable))
    out = agg.select(
        "partner_id", "jaar", F.col("n").cast("bigint").alias("aantal"), F.col("s").cast(TOTAL).alias("bedrag"),
        "naam", "voornaam", "achternaam", R.mailing_line("straat", "huisnummer", "bus").alias("adres"),
        *MAILING_KEYS[4:], *status,
    )
    return out.orderBy(F.col("partner_id").asc_nulls_last())


# ---------------------------------------------------------------- totals, look-ups
def project_totals(ledger: GiftLedger) -> DataFrame:
    agg = ledger.aggregate(["project"], [], {"s": F.sum("amount")}, {"s": F.sum("s")})
    return agg.select(F.col("s").cast(TOTAL).alias("bedrag"), "project")


def _squeezed_lower(col):
    return F.lower(F.regexp_replace(col, " ", ""))


def provider_gifts(ledger: GiftLedger, pattern: str, exclusions=PROVIDER_EXCLUSIONS) -> DataFrame:
    """Gifts paid through a payment provider: description (spaces removed,
    lower case) contains ``pattern`` and none of the exclusion codes; with
    the cleaned transaction key."""
    desc = F.col("description")
    cond = _squeezed_lower(desc).contains(pattern)
    for code in exclusions:
        cond = cond & ~F.lower(desc).contains(code)
    key = F.regexp_replace(F.lower(desc), " ", "")
    for removal in PROVIDER_KEY_REMOVALS:
        key = F.replace(key, F.lit(removal), F.lit(""))
    rows = ledger.rows(fact_filter=cond)
    return rows.select(key.alias("transaction"), *EXTRACT_COLUMNS)


def ledger_lookup(ledger: GiftLedger, partner_id=None, amount=None, selection: Selection = EVERYTHING,
                  order_by: str = "date") -> DataFrame:
    """Ledger rows by partner, amount and the conditions of ``selection``
    (dates, source, project code or name, description, department ...)."""
    cond = F.lit(True) if selection.gift() is None else selection.gift()
    if partner_id is not None:
        cond = cond & (F.col("partner_id") == partner_id)
    if amount is not None:
        cond = cond & (F.col("amount") == F.lit(amount))
    rows = ledger.rows(fact_filter=cond, donor_filter=selection.donor())
    # the further columns spread one date (one donor) over the sort's ranges
    return rows.orderBy(F.col(order_by).asc_nulls_last(), "date", "partner_id", "amount")


def ledger_dates(ledger: GiftLedger, bron=None) -> DataFrame:
    """Distinct gift dates (optionally of one source) of the ledger."""
    facts = ledger.bare_facts if bron is None else ledger.bare_facts.where(F.col("bron") == bron)
    # only the eligibility of the gift's partner is needed, not its columns
    rows = facts.select("partner_id", "branch", "date").join(ledger.partners(()), "partner_id", "inner")
    return rows.where((F.col("branch") != ACTIVE) | F.col("eligible")).select("date").distinct()


PROFILE_COLUMNS = ("jaareerstegift", "jaarlaatstegift", "jarendonateur", "aantalgiften", "totaalgiften",
                   "grootstegift", "avggiftenperjaar", "avgbedragperjaar")


def profile_enrichment(ledger: GiftLedger, t) -> DataFrame:
    """Ledger rows of newsletter subscribers with their donor profile."""
    news = t.newsletter.select(F.col("partner_id").alias("n_partner_id"))
    prof = donor_profile(t, only=news).select(F.col("partner_id").alias("dp_partner_id"), *PROFILE_COLUMNS)
    ext = (
        ledger.partners(PARTNER_COLUMNS, only=news).join(news, F.col("partner_id") == F.col("n_partner_id"), "inner")
        .join(prof, F.col("partner_id") == F.col("dp_partner_id"), "inner")
    )
    joined = ledger.facts.join(ext, "partner_id", "inner")
    joined = joined.where((F.col("branch") != ACTIVE) | F.col("eligible"))
    return joined.select(*[GiftLedger.attr(c) for c in EXTRACT_COLUMNS], *PROFILE_COLUMNS)
