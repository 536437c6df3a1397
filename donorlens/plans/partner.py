"""Partner dimension: one row per partner with its lookup columns attached.

Columns of ``res_partner`` are prefixed ``p_``; lookups add ``c_*``
(country), ``cs_*`` (state), ``ccs_*`` (register street), ``cc_*``
(register city), ``pt_*`` (title), ``pct_*`` (legal form), ``a_*`` /
``a2_*`` (assigned / chosen department, both partners), ``a5_*`` (related
partner).  Only the lookups a report asks for are joined, so an extract
that needs no department pays no self-join.

The dimension is partner-sized: it is built once per plan and joined to the
(much larger) gift facts on ``p_id`` late, after the facts were filtered and,
where the report allows, aggregated per partner.  Derived address / consent
columns are computed *after* that join (``rules`` on the joined frame), so
gifts without a partner get the same defaults as in a left join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .joins import lookup

LOOKUPS = ("country", "state", "street", "city", "title", "legal", "dept", "dept_choice", "relation")


def _renamed(df: DataFrame, prefix: str, cols: Iterable[str]) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}_{c}") for c in cols])


def partner_dim(t, lookups: Iterable[str] = LOOKUPS, only: DataFrame | None = None) -> DataFrame:
    """The dimension with ``lookups``; of the partners whose ids ``only`` (one
    column) lists, if it is given."""
    wanted = frozenset(lookups)
    memo = getattr(t, "memo", None)
    if only is not None:
        return _partner_dim(t, wanted, only)
    if memo is not None:
        return memo(("partner_dim", wanted), lambda: _partner_dim(t, wanted))
    return _partner_dim(t, wanted)


def _partner_dim(t, wanted: frozenset, only: DataFrame | None = None) -> DataFrame:
    unknown = wanted - set(LOOKUPS)
    if unknown:
        raise ValueError(f"unknown partner lookups {sorted(unknown)}")
    partners = t.res_partner
    p = partners.select([F.col(c).alias(f"p_{c}") for c in partners.columns])
    if only is not None:
        p = p.join(only, F.col("p_id") == F.col(only.columns[0]), "left_semi")
    names = partners.select("id", "name")
    # only partners that are somebody's department: few rows, so their joins need not shuffle the partners
    used = (partners.select(F.explode(F.array("department_id", "department_choice_id")).alias("used_id"))
            .where("used_id IS NOT NULL").distinct())
    departments = names.join(used, F.col("id") == F.col("used_id"), "left_semi")
    specs = {
        "country": (t.res_country, "c", ("id", "name"), "p_country_id"),
        "state": (t.res_country_state, "cs", ("id", "name"), "p_state_id"),
        "street": (t.res_country_city_street, "ccs", ("id", "name"), "p_street_id"),
        "city": (t.res_country_city, "cc", ("id", "name", "zip"), "p_zip_id"),
        "title": (t.res_partner_title, "pt", ("id", "shortcut"), "p_title"),
        "legal": (t.res_partner_corporation_type, "pct", ("id", "name"), "p_corporation_type_id"),
        "dept": (departments, "a", ("id", "name"), "p_department_id"),
        "dept_choice": (departments, "a2", ("id", "name"), "p_department_choice_id"),
        "relation": (names, "a5", ("id", "name"), "p_relation_partner_id"),
    }
    for key in LOOKUPS:
        if key not in wanted:
            continue
        table, prefix, cols, fk = specs[key]
        dim = _renamed(table, prefix, cols)
        # many partners share one department: a hot key on the partner side;
        # adaptive execution splits such partitions of the sort-merge join
        p = lookup(p, dim, F.col(fk) == F.col(f"{prefix}_id"), "left")
    return p


# ----------------------------------------------------------------------------
# Partner-derived columns, evaluated on a frame that carries partner_dim cols.
# ----------------------------------------------------------------------------
def label():
    return R.partner_label("p_id", "p_name")


def afdeling():
    return R.department("a2_name", "a_name")


def afdeling_id():
    return R.department_id("a2_id", "a_id")


def straat():
    return R.street("c_id", "p_crab_used", "ccs_name", "p_street")


def huisnummer():
    return R.house_number("c_id", "p_crab_used", "p_street_nbr")


def postcode():
    return R.postcode("c_id", "p_crab_used", "cc_zip", "p_zip")


def gemeente():
    return R.municipality("c_id", "cc_name", "p_city")


def provincie_zip():
    return R.province_from_zip("p_country_id", "p_zip")


def provincie_state():
    return R.province_from_state("c_id", "p_zip", "cs_name")


def aanspreking():
    return R.salutation("p_gender", "pt_shortcut")


def email_ontvangen():
    return R.consent("p_opt_out")


def post_ontvangen():
    return R.consent("p_opt_out_letter")


def adres_status():
    return R.address_state("p_address_state_id")


def overleden():
    return R.is_deceased("p_deceased")
