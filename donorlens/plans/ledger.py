"""Gift ledgers: the enriched gift lists every report starts from.

Three families share the same building blocks (narrow facts from
``facts``, partner columns from ``partner``):

* ``income_ledger``  - the 55-column extract of the table functions: gifts
  (accounts 732000/732100) or marketing income (plus 734000/740500), booked
  lines UNION ALL payment history.
* ``GiftLedger``     - the 49-column analyst ledger: booked gifts of active
  or deceased partners, booked gifts of inactive partners moved to their
  surviving partner, payment history; text columns NULL-filled.  It keeps
  facts and partner columns apart so reports aggregate gifts per partner
  *before* the partner attributes are attached.
* ``legacy_ledger``  - bequests, selected by project code.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from . import partner as P
from .facts import history_lines, on_projects, posted_lines, project_code, project_name
from .joins import left_join_spread_nulls

MONEY = "decimal(15,2)"
AMOUNT = "decimal(16,2)"


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


# ============================================================================
# 55-column extract (gift ledger / marketing income)
# ============================================================================
INCOME_LOOKUPS = ("country", "street", "city", "title", "dept", "dept_choice", "relation")


# columns of the gift itself, in both branches
INCOME_FACTS = (
    "account_id", "date", "debet", "credit", "amount", "partner_id", "description", "ref", "dimensie1", "dimensie2",
    "dimensie3", "code1", "code2", "code3", "project_code", "project", "grootboekrek", "grootboekrek_naam",
    "fiscaal_attest", "boeking", "boeking_type", "vzw", "bron",
)
INCOME_COLUMNS = (
    "account_id", "date", "jaar", "maand", "week", "debet", "credit", "amount", "partner_id",
    "huidige_lidmaatschap_status", "lidnummer", "partner", "naam", "voornaam", "achternaam", "afdeling", "afdeling_id",
    "opzegdatum", "straat", "huisnummer", "bus", "postcode", "gemeente", "postbus", "provincie", "land",
    "geboorte_datum", "naam_partner", "adres_status", "email_ontvangen", "post_ontvangen", "nooit_contacteren",
    "overleden", "email", "aanspreking", "geslacht", "description", "ref", "dimensie1", "dimensie2", "dimensie3",
    "code1", "code2", "code3", "project_code", "project", "grootboekrek", "grootboekrek_naam", "fiscaal_attest",
    "boeking", "boeking_type", "rechtspersoon", "particuliere_gift", "vzw", "bron",
)
BOOKED, EARLIER = "erp", "npca"


def _income_facts(posted: bool) -> list[Column]:
    """INCOME_FACTS of a booked line (``posted``) or of the payment history."""
    values = {"date": F.col("date"), "partner_id": F.col("partner_id")} | ({
        "account_id": F.col("account_id").cast("int"),
        "debet": F.col("debit"),
        "credit": F.col("credit"),
        "amount": R.gift_amount().cast(AMOUNT),
        "description": R.clean_text("name"),
        "ref": F.col("ref"),
        "dimensie1": R.or_empty("d1_name"),
        "dimensie2": R.or_empty("d2_name"),
        "dimensie3": R.or_empty("d3_name"),
        "code1": R.or_empty("d1_code"),
        "code2": R.or_empty("d2_code"),
        "code3": R.or_empty("d3_code"),
        "project_code": project_code(),
        "project": project_name(),
        "grootboekrek": F.col("aa_code"),
        "grootboekrek_naam": R.clean_separator("aa_name"),
        "fiscaal_attest": R.certificate_flag("aa_code"),
        "boeking": F.col("am_name"),
        "boeking_type": R.posting_type("am_name"),
        "vzw": F.col("rc_name"),
        "bron": F.lit(BOOKED),
    } if posted else {
        "account_id": _null("int"),
        "debet": _null(MONEY),
        "credit": _null(MONEY),
        "amount": F.col("amount").cast(AMOUNT),
        "description": R.clean_text("description"),
        "dimensie1": F.col("project_nbr"),
        "dimensie2": F.col("cost_center"),
        "project_code": R.history_project("project_nbr", "cost_center"),
        "fiscaal_attest": _null("boolean"),
        "bron": F.lit(EARLIER),
    })
    return [values.get(c, _null("string")).alias(c) for c in INCOME_FACTS]


def _income_columns(prefixed_bus: bool) -> list[Column]:
    """INCOME_COLUMNS of facts joined with the partner dimension."""
    booked = F.col("bron") == BOOKED

    def branch(posted: Column, history: Column) -> Column:
        return F.when(booked, posted).otherwise(history)

    bus = R.bus_prefixed("p_street_bus") if prefixed_bus else R.bus_or_empty("p_street_bus")
    values = {
        "jaar": R.year_of("date"),
        "maand": R.month_of("date"),
        "week": R.iso_week_of("date"),
        "partner_id": F.col("p_id"),
        "huidige_lidmaatschap_status": branch(F.col("p_membership_state"), F.col("p_membership_state_b")),
        "lidnummer": F.col("p_membership_nbr"),
        "partner": P.label(),
        "naam": F.col("p_name"),
        "voornaam": F.col("p_first_name"),
        "achternaam": F.col("p_last_name"),
        "afdeling": P.afdeling(),
        "afdeling_id": P.afdeling_id(),
        "opzegdatum": branch(F.col("p_membership_cancel"), F.col("p_membership_cancel_b")),
        "straat": P.straat(),
        "huisnummer": P.huisnummer(),
        "bus": branch(bus, F.col("p_street_bus")),
        "postcode": P.postcode(),
        "gemeente": P.gemeente(),
        "postbus": F.col("p_postbus_nbr"),
        "provincie": P.provincie_zip(),
        "land": F.col("c_name"),
        "geboorte_datum": F.col("p_birthday"),
        "naam_partner": F.col("a5_name"),
        "adres_status": P.adres_status(),
        "email_ontvangen": P.email_ontvangen(),
        "post_ontvangen": P.post_ontvangen(),
        "nooit_contacteren": F.col("p_iets_te_verbergen"),
        "overleden": P.overleden(),
        "email": F.col("p_email"),
        "aanspreking": P.aanspreking(),
        "geslacht": F.col("p_gender"),
        "rechtspersoon": F.col("p_corporation_type_id"),
        "particuliere_gift": branch(R.organisation_flag("p_organisation_type_id", "p_corporation_type_id"), _null("int")),
    }
    return [values.get(c, F.col(c)).alias(c) for c in INCOME_COLUMNS]


def income_ledger(
    t,
    start,
    end,
    codes=R.GIFT_ACCOUNTS,
    partner_id: int | None = None,
    keep_unassigned: bool = False,
    prefixed_bus: bool = False,
) -> DataFrame:
    """Booked lines on ``codes`` UNION ALL payment history, 55 columns.

    ``keep_unassigned`` keeps booked lines without a partner (marketing
    income); otherwise only lines of an existing partner are returned, or of
    ``partner_id`` when it is given and positive.  The narrow gifts of both
    branches are joined with the partner dimension once.
    """
    one = partner_id is not None and partner_id > 0
    facts = posted_lines(t, start, end, codes).select(_income_facts(True)).unionByName(
        history_lines(t, start, end).select(_income_facts(False)))
    if one:
        facts = facts.where(F.col("partner_id") == partner_id)
    pdim = P.partner_dim(t, INCOME_LOOKUPS)
    if one or not keep_unassigned:
        pdim = pdim.where((F.col("p_id") == partner_id) if one else (F.col("p_id") > 0))
    if keep_unassigned:
        joined = left_join_spread_nulls(facts, pdim, "partner_id", "p_id")
    else:
        joined = facts.join(pdim, F.col("partner_id") == F.col("p_id"), "inner")
    # the payment history has an inner join with the country
    kept = joined.where((F.col("bron") == BOOKED) | F.col("c_id").isNotNull())
    return kept.select(_income_columns(prefixed_bus))


# ============================================================================
# 49-column analyst ledger
# ============================================================================
EXTRACT_COLUMNS = (
    "acount_id", "date", "jaar", "maand", "debet", "credit", "amount", "partner_id", "inact_partner_id",
    "huidige_lidmaatschap_status", "lidnummer", "partner", "naam", "voornaam", "achternaam", "afdeling",
    "opzegdatum", "straat", "huisnummer", "bus", "postcode", "gemeente", "postbus", "provincie", "land",
    "rijksregisternummer", "geboorte_datum", "naam_partner", "adres_status", "email_ontvangen",
    "post_ontvangen", "nooit_contacteren", "overleden", "email", "aanspreking", "geslacht", "rechtspersoon",
    "description", "ref", "dimensie1", "dimensie2", "dimensie3", "project_code", "project", "grootboekrek",
    "grootboekrek_naam", "vzw", "boeking", "bron",
)
FACT_COLUMNS = (
    "acount_id", "date", "jaar", "maand", "debet", "credit", "amount", "partner_id", "inact_partner_id",
    "description", "ref", "dimensie1", "dimensie2", "dimensie3", "project_code", "project", "grootboekrek",
    "grootboekrek_naam", "vzw", "boeking", "bron",
)
# partner columns that differ between booked gifts and payment history
BRANCH_COLUMNS = {
    "huidige_lidmaatschap_status": ("p_membership_state", "p_membership_state_b"),
    "opzegdatum": ("p_membership_cancel", "p_membership_cancel_b"),
}
PARTNER_COLUMNS = tuple(c for c in EXTRACT_COLUMNS if c not in FACT_COLUMNS)
ACTIVE, MOVED, HISTORY = "active", "moved", "history"


@dataclass
class GiftLedger:
    """Ledger as (facts, partners); ``wide()`` gives the 49-column table."""

    facts: DataFrame  # FACT_COLUMNS + branch
    stored: DataFrame | None = None  # written partner attributes, one row per partner_id; else built from ``tables``
    unnamed: DataFrame | None = None  # the facts without the join for the move name (boeking NULL)
    tables: object | None = None

    def partners(self, columns: Iterable[str] = PARTNER_COLUMNS, only: DataFrame | None = None) -> DataFrame:
        """partner_id, eligible and the attributes behind ``columns``; only
        the lookups that these need are joined, and only for the partners
        whose ids ``only`` (one column) lists."""
        raw = list(dict.fromkeys(r for c in columns if c != "partner_id" for r in BRANCH_COLUMNS.get(c, (c,))))
        if self.stored is not None:
            stored = self.stored.select("partner_id", "eligible", *raw)
            return stored if only is None else stored.join(only, F.col("partner_id") == F.col(only.columns[0]), "left_semi")
        return _extract_partners(self.tables, raw, only)

    @property
    def bare_facts(self) -> DataFrame:
        """Facts for reports that do not print the move name."""
        return self.facts if self.unnamed is None else self.unnamed

    def fact_parts(self) -> list[DataFrame] | None:
        """Facts stored apart, to be folded apart; None: only ``facts``."""
        return None

    def _eligible(self, df: DataFrame) -> DataFrame:
        # booked gifts count for active partners and for deceased inactive ones
        return df.where((F.col("branch") != ACTIVE) | F.col("eligible"))

    @staticmethod
    def attr(name: str) -> Column:
        if name in BRANCH_COLUMNS:
            booked, history = BRANCH_COLUMNS[name]
            return F.when(F.col("branch") == HISTORY, F.col(history)).otherwise(F.col(booked)).alias(name)
        return F.col(name)

    def wide(self) -> DataFrame:
        joined = self._eligible(self.facts.join(self.partners(), "partner_id", "inner"))
        return joined.select([self.attr(c) if c not in FACT_COLUMNS else F.col(c) for c in EXTRACT_COLUMNS])

    def aggregate(
        self,
        fact_keys: list[str],
        partner_keys: list[str],
        partials: dict[str, Column],
        finals: dict[str, Column],
        fact_filter: Column | None = None,
        partner_filter: Column | None = None,
        fact_exprs: dict[str, Column] | None = None,
        partners: DataFrame | None = None,
        filter_columns: Iterable[str] = (),
    ) -> DataFrame:
        """Group the ledger by fact and partner columns in two phases.

        Phase 1 groups the facts per (partner, branch, fact keys) with
        map-side partial aggregation, so a donor holding a third of all gifts
        is folded before any shuffle; only those partial rows meet the
        partner attributes; phase 2 groups them by the report's keys.
        ``finals`` must combine ``partials`` (sum of sums, min of mins, ...).
        ``fact_exprs`` adds derived fact columns usable as keys; ``partners``
        replaces the partner attributes (e.g. extended by a partner-level join,
        whose repetitions then multiply sums exactly as a row-level join);
        ``filter_columns`` names what ``partner_filter`` reads beside the keys.
        """
        attrs = self.partners([*partner_keys, *filter_columns]) if partners is None else partners

        def folded(facts: DataFrame) -> DataFrame:
            facts = facts if fact_filter is None else facts.where(fact_filter)
            if fact_exprs:
                facts = facts.select("*", *[c.alias(n) for n, c in fact_exprs.items()])
            part = facts.groupBy("partner_id", "branch", *fact_keys).agg(
                *[c.alias(n) for n, c in partials.items()]
            )
            return self._eligible(part.join(attrs, "partner_id", "inner"))

        first, *rest = self.fact_parts() or [self.facts if "boeking" in fact_keys else self.bare_facts]
        joined = folded(first)
        for more in rest:
            joined = joined.unionByName(folded(more))
        if partner_filter is not None:
            joined = joined.where(partner_filter)
        joined = joined.select(
            "partner_id", *fact_keys, *partials, *[self.attr(k).alias(k) for k in partner_keys if k != "partner_id"]
        )
        keys = list(dict.fromkeys([*fact_keys, *partner_keys]))
        return joined.groupBy(*keys).agg(*[c.alias(n) for n, c in finals.items()])

    def materialize(self, spark, name: str | None = None) -> GiftLedger:
        """Write facts and partner attributes under the session's shared
        checkpoint folder and return a ledger reading them back.

        For the analyst flow that runs many reports on one ledger: the
        ledger is computed once, later reports start from the written tables
        (their lineage is cut, so a lost executor never recomputes the
        ledger).  The folder comes from ``spark.checkpoint.dir``."""
        import uuid

        from ..session import checkpoint_dir

        root = f"{checkpoint_dir(spark).rstrip('/')}/{name or 'gift-ledger-' + uuid.uuid4().hex}"
        # partitioned by year: date-limited reports on the stored ledger
        # read only their years
        self.facts.write.mode("overwrite").partitionBy("jaar").parquet(f"{root}/facts")
        self.partners().write.mode("overwrite").parquet(f"{root}/partners")
        facts = spark.read.parquet(f"{root}/facts").select(*self.facts.columns)
        return GiftLedger(facts, spark.read.parquet(f"{root}/partners"))

    def rows(self, fact_filter: Column | None = None, donor_filter: Column | None = None) -> DataFrame:
        """The wide ledger restricted by a fact predicate (pushed below the
        join) and a predicate on the donor's columns."""
        facts = self.facts if fact_filter is None else self.facts.where(fact_filter)
        wide = GiftLedger(facts, self.stored, tables=self.tables).wide()
        return wide if donor_filter is None else wide.where(donor_filter)


def stored_partners(t) -> DataFrame:
    """All partner attributes of a stored ledger, one row per partner."""
    return _extract_partners(t, dict.fromkeys(r for c in PARTNER_COLUMNS for r in BRANCH_COLUMNS.get(c, (c,))))


# lookups behind the attributes that need one
ATTRIBUTE_LOOKUPS = {
    "afdeling": ("dept", "dept_choice"),
    "straat": ("country", "street"),
    "huisnummer": ("country",),
    "postcode": ("country", "city"),
    "gemeente": ("country", "city"),
    "provincie": ("country", "state"),
    "land": ("country",),
    "naam_partner": ("relation",),
    "aanspreking": ("title",),
    "rechtspersoon": ("legal",),
}


def _extract_partners(t, columns: Iterable[str], only: DataFrame | None = None) -> DataFrame:
    """Partner attributes of the analyst ledger, NULL text already filled."""
    pdim = P.partner_dim(t, {lookup for c in columns for lookup in ATTRIBUTE_LOOKUPS.get(c, ())}, only)
    attributes = {
        "lidnummer": R.or_empty("p_membership_nbr"),
        "partner": P.label(),
        "naam": F.col("p_name"),
        "voornaam": R.or_empty("p_first_name"),
        "achternaam": R.or_empty("p_last_name"),
        "afdeling": P.afdeling(),
        "straat": P.straat(),
        "huisnummer": R.or_empty(P.huisnummer()),
        "bus": R.or_empty("p_street_bus"),
        "postcode": P.postcode(),
        "gemeente": P.gemeente(),
        "postbus": F.col("p_postbus_nbr"),
        "provincie": P.provincie_state(),
        "land": F.col("c_name"),
        "rijksregisternummer": F.col("p_national_id_nbr"),
        "geboorte_datum": F.col("p_birthday"),
        "naam_partner": F.col("a5_name"),
        "adres_status": P.adres_status().cast("string"),
        "email_ontvangen": P.email_ontvangen(),
        "post_ontvangen": P.post_ontvangen(),
        "nooit_contacteren": R.bool_text("p_iets_te_verbergen"),
        "overleden": R.bool_text(P.overleden()),
        "email": R.or_empty("p_email"),
        "aanspreking": P.aanspreking(),
        "geslacht": F.col("p_gender"),
        "rechtspersoon": F.col("pct_name"),
    }
    return pdim.select(
        F.col("p_id").alias("partner_id"),
        R.active_or_deceased("p_active", "p_deceased").alias("eligible"),
        *[attributes.get(c, F.col(c)).alias(c) for c in columns],
    )


def _posted_fact_columns() -> list[Column]:
    return [
        F.col("account_id").cast("int").alias("acount_id"),
        F.col("date"),
        R.year_of("date").alias("jaar"),
        R.month_of("date").alias("maand"),
        F.col("debit").alias("debet"),
        F.col("credit"),
        R.gift_amount().cast(AMOUNT).alias("amount"),
        F.col("partner_id"),
        F.col("inact_partner_id"),
        R.clean_text("name").alias("description"),
        F.col("ref"),
        R.or_empty("d1_name").alias("dimensie1"),
        R.or_empty("d2_name").alias("dimensie2"),
        R.or_empty("d3_name").alias("dimensie3"),
        project_code().alias("project_code"),
        project_name().alias("project"),
        F.col("aa_code").alias("grootboekrek"),
        R.clean_separator("aa_name").alias("grootboekrek_naam"),
        F.col("rc_name").alias("vzw"),
        F.col("am_name").alias("boeking"),
        F.lit("ERP").alias("bron"),
        F.col("branch"),
    ]


def gift_ledger(t, start, end, codes=R.GIFT_ACCOUNTS) -> GiftLedger:
    """The analyst ledger over [start, end] (booked gifts + history)."""
    memo = getattr(t, "memo", None)
    key = ("gift_ledger", str(start), str(end), tuple(codes))
    if memo is not None:
        return memo(key, lambda: _gift_ledger(t, start, end, codes))
    return _gift_ledger(t, start, end, codes)


def loaded_facts(t, start, end, codes, stage) -> DataFrame:
    """The facts of ``gift_ledger`` for a load, which stores the booked lines by ``stage`` on the way."""
    return _booked_facts(t, start, end, codes, True, stage=stage).unionByName(_history_facts(t, start, end))


def successors(t) -> DataFrame:
    """(old_id, new_id): inactive partners and the partner that took their place."""
    return t.res_partner.where(
        (F.col("active") == F.lit(False)) & (F.coalesce(F.col("active_partner_id"), F.lit(0)) > 0)
    ).select(F.col("id").alias("old_id"), F.col("active_partner_id").alias("new_id"))


def _booked_facts(t, start, end, codes, with_move: bool, branches: tuple[str, ...] = (ACTIVE, MOVED), stage=None) -> DataFrame:
    """Booked gifts from one scan: each counts for its partner, and once more,
    moved, for the surviving partner of an inactive one.  Of the moved gifts
    alone only the lines of partners with a successor are looked up."""
    gone = successors(t)
    of_successors = None
    if branches == (MOVED,):
        def of_successors(lines: DataFrame) -> DataFrame:
            return lines.join(gone, F.col("partner_id") == F.col("old_id"), "inner")
    booked = posted_lines(t, start, end, codes, with_move=with_move, restrict=of_successors, stage=stage).where(F.col("partner_id").isNotNull())
    if not with_move:
        booked = booked.select("*", _null("string").alias("am_name"))

    def role(partner: Column, inactive: Column, branch: str) -> Column:
        return F.struct(partner.alias("partner_id"), inactive.cast("bigint").alias("inact_partner_id"), F.lit(branch).alias("branch"))

    own = role(F.col("partner_id"), F.lit(None), ACTIVE)
    moved = role(F.col("new_id"), F.col("old_id"), MOVED)
    if branches == (MOVED,):
        lines = booked.select(*[F.col(c) for c in booked.columns if c != "partner_id"], moved.alias("role"))
    elif branches == (ACTIVE,):
        lines = booked.select(*[F.col(c) for c in booked.columns if c != "partner_id"], own.alias("role"))
    else:
        roles = F.when(F.col("new_id").isNull(), F.array(own)).otherwise(F.array(own, moved))
        lines = booked.join(gone, F.col("partner_id") == F.col("old_id"), "left").select(
            *[F.col(c) for c in booked.columns if c != "partner_id"], F.explode(roles).alias("role"))
    return lines.select("*", "role.*").select(_posted_fact_columns())


def _history_facts(t, start, end) -> DataFrame:
    return history_lines(t, start, end).select(
        _null("int").alias("acount_id"),
        F.col("date"),
        R.year_of("date").alias("jaar"),
        R.month_of("date").alias("maand"),
        _null(MONEY).alias("debet"),
        _null(MONEY).alias("credit"),
        F.col("amount").cast(AMOUNT).alias("amount"),
        F.col("partner_id"),
        _null("bigint").alias("inact_partner_id"),
        R.clean_text("description").alias("description"),
        _null("string").alias("ref"),
        F.col("project_nbr").alias("dimensie1"),
        F.col("cost_center").alias("dimensie2"),
        _null("string").alias("dimensie3"),
        R.history_project("project_nbr", "cost_center").alias("project_code"),
        _null("string").alias("project"),
        _null("string").alias("grootboekrek"),
        _null("string").alias("grootboekrek_naam"),
        _null("string").alias("vzw"),
        _null("string").alias("boeking"),
        F.lit("npca").alias("bron"),
        F.lit(HISTORY).alias("branch"),
    )


def _gift_ledger(t, start, end, codes) -> GiftLedger:
    hist = _history_facts(t, start, end)
    return GiftLedger(
        _booked_facts(t, start, end, codes, True).unionByName(hist),
        unnamed=_booked_facts(t, start, end, codes, False).unionByName(hist), tables=t)


def branch_ledger(t, start, end, branch: str, codes=R.GIFT_ACCOUNTS) -> GiftLedger:
    """One branch of the analyst ledger; the tables of the others are not read."""
    if branch == HISTORY:
        return GiftLedger(_history_facts(t, start, end), tables=t)
    if branch not in (ACTIVE, MOVED):
        raise ValueError(f"unknown branch {branch!r}")
    return GiftLedger(_booked_facts(t, start, end, codes, True, (branch,)), tables=t)


# ============================================================================
# Legacies
# ============================================================================
LEGACY_PROJECT_PATTERN = "L-%"
# columns of the staged legacies, and those that the report prints
LEGACY_COLUMNS = (
    "acount_id", "date", "jaar", "maand", "debet", "credit", "amount", "partner_id", "huidige_lidmaatschap_status",
    "lidnummer", "partner", "naam", "voornaam", "achternaam", "afdeling", "opzegdatum", "straat", "huisnummer", "bus",
    "postcode", "gemeente", "postbus", "provincie", "land", "geboorte_datum", "naam_partner", "adres_status",
    "email_ontvangen", "post_ontvangen", "nooit_contacteren", "overleden", "email", "aanspreking", "geslacht",
    "rechtspersoon", "description", "ref", "dimensie1", "dimensie2", "dimensie3", "project_code", "project",
    "grootboekrek", "grootboekrek_naam", "vzw", "boeking", "bron",
)
LEGACY_PRINTED = (
    "date", "jaar", "amount", "partner_id", "huidige_lidmaatschap_status", "lidnummer", "partner", "description",
    "ref", "dimensie1", "dimensie2", "dimensie3", "project_code", "project", "grootboekrek", "grootboekrek_naam",
    "vzw", "boeking",
)


def _legacy_partners(t, columns: tuple[str, ...]) -> DataFrame:
    lookups = {lookup for c in columns for lookup in ATTRIBUTE_LOOKUPS.get(c, ())}
    return P.partner_dim(t, (lookups - {"state"}) | {"country"}).where(F.col("c_id").isNotNull())


def _legacy_columns(posted: bool, columns: tuple[str, ...]) -> list[Column]:
    fact = {
        "acount_id": F.col("account_id").cast("int"), "debet": F.col("debit"), "credit": F.col("credit"),
        "amount": R.gift_amount().cast(AMOUNT), "description": R.clean_text("name"), "ref": F.col("ref"),
        "dimensie1": R.or_empty("d1_name"), "dimensie2": R.or_empty("d2_name"), "dimensie3": R.or_empty("d3_name"),
        "project_code": project_code(), "project": project_name(), "grootboekrek": F.col("aa_code"),
        "grootboekrek_naam": R.clean_separator("aa_name"), "vzw": F.col("rc_name"), "boeking": F.col("am_name"),
        "bron": F.lit("ERP"), "huidige_lidmaatschap_status": F.col("p_membership_state"),
        "opzegdatum": F.col("p_membership_cancel"),
    } if posted else {
        "acount_id": _null("int"), "debet": _null(MONEY), "credit": _null(MONEY),
        "amount": F.col("amount").cast(AMOUNT), "description": R.clean_text("description"), "ref": _null("string"),
        "dimensie1": F.col("project_nbr"), "dimensie2": F.col("cost_center"), "dimensie3": _null("string"),
        "project_code": R.history_project("project_nbr", "cost_center"), "project": _null("string"),
        "grootboekrek": _null("string"), "grootboekrek_naam": _null("string"), "vzw": _null("string"),
        "boeking": _null("string"), "bron": F.lit("npca"),
        "huidige_lidmaatschap_status": F.col("p_membership_state_b"), "opzegdatum": F.col("p_membership_cancel_b"),
    }
    person = {
        "date": F.col("date"), "jaar": R.year_of("date"), "maand": R.month_of("date"), "partner_id": F.col("p_id"),
        "lidnummer": F.col("p_membership_nbr"), "partner": P.label(), "naam": F.col("p_name"),
        "voornaam": F.col("p_first_name"), "achternaam": F.col("p_last_name"), "afdeling": P.afdeling(),
        "straat": P.straat(), "huisnummer": P.huisnummer(), "bus": F.col("p_street_bus"), "postcode": P.postcode(),
        "gemeente": P.gemeente(), "postbus": F.col("p_postbus_nbr"), "provincie": P.provincie_zip(),
        "land": F.col("c_name"), "geboorte_datum": F.col("p_birthday"), "naam_partner": F.col("a5_name"),
        "adres_status": P.adres_status().cast("string"), "email_ontvangen": P.email_ontvangen(),
        "post_ontvangen": P.post_ontvangen(), "nooit_contacteren": R.bool_text("p_iets_te_verbergen"),
        "overleden": R.bool_text(P.overleden()), "email": F.col("p_email"), "aanspreking": P.aanspreking(),
        "geslacht": F.col("p_gender"), "rechtspersoon": F.col("pct_name"),
    }
    return [(fact | person)[c].alias(c) for c in columns]


def _by_project(legacies: DataFrame) -> DataFrame:
    # the further columns spread one project's gifts over the sort's ranges
    return legacies.orderBy(F.col("project_code").asc_nulls_last(), "date", "partner_id", "amount")


def legacy_ledger(t, start, end, columns: tuple[str, ...] = LEGACY_PRINTED) -> DataFrame:
    """Bequests: booked lines on a legacy project (code ``L-...``) of an
    active or deceased partner with a known country, ordered by project.
    ``columns=LEGACY_COLUMNS`` gives the whole staged row."""
    lines = posted_lines(t, start, end, codes=None, restrict=on_projects(t, LEGACY_PROJECT_PATTERN)).where(
        project_code().like(LEGACY_PROJECT_PATTERN))
    pdim = _legacy_partners(t, columns).where(R.active_or_deceased("p_active", "p_deceased"))
    joined = lines.join(pdim, F.col("partner_id") == F.col("p_id"), "inner")
    return _by_project(joined.select(_legacy_columns(True, columns)))


def legacy_history(t, start, end, columns: tuple[str, ...] = LEGACY_PRINTED) -> DataFrame:
    """Payment-history gifts of [start, end] in the legacy report's columns
    (partner with a known country, history project rule)."""
    joined = history_lines(t, start, end).join(_legacy_partners(t, columns), F.col("partner_id") == F.col("p_id"), "inner")
    return _by_project(joined.select(_legacy_columns(False, columns)))
