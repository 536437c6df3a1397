"""Shared business rules as Column expressions.

Every rule is a pure function returning a ``Column`` built from built-in
functions only, so it stays inside whole-stage codegen and never blocks
predicate pushdown.  Arguments are column names (or Columns) of the joined
fact / partner frame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Fixed values of the reports: ledger codes, country ids, labels.
# --------------------------------------------------------------------------
GIFT_ACCOUNTS = ("732100", "732000")  # gifts, gifts with a tax certificate
CERTIFICATE_ACCOUNT = "732000"
SUSPENSE_ACCOUNT = "499010"
MARKETING_ACCOUNTS = ("740500", "734000", "732100", "732000")
BELGIUM = 21
NETHERLANDS = 166
UNKNOWN_DEPARTMENT = "onbekend"
YES, NO = "JA", "NEEN"
CORRECTION, NORMAL = "correctie", "normaal (geen correctie)"
MONTH_LABELS = ("Jan", "Feb", "Maa", "Apr", "Mei", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dec")
# (lowest, highest, province) of Belgian postcodes; other Belgian codes are Wallonia
PROVINCE_ZIP_RANGES = (
    (1000, 1299, "Brussel"),
    (1500, 1999, "Vlaams Brabant"),
    (3000, 3499, "Vlaams Brabant"),
    (2000, 2999, "Antwerpen"),
    (3500, 3999, "Limburg"),
    (8000, 8999, "West-Vlaanderen"),
    (9000, 9999, "Oost-Vlaanderen"),
)
WALLONIA = "Wallonië"
NETHERLANDS_LABEL = "Nederland"
ABROAD = "Buitenland niet NL"
OTHER = "andere"
EAST_FLANDERS = "Oost-Vlaanderen"
# organisation types that are internal entities; corporation type classes
INTERNAL_ORGANISATIONS = (1, 3, 5, 7, 8, 16)
DONOR_CLASSES = (
    ("Vennootschap", (1, 12)),
    ("Publiekrechterlijk", (13, 13)),
    ("Stichting", (15, 16)),
    ("Vereniging", (17, 17)),
)
INTERNAL, PRIVATE = "Intern", "Private persoon"
STATUS_POSTED, STATUS_CHECKED, STATUS_UNPROCESSED = "gevalideerd", "gecontroleerd", "niet verwerkt"
NO_CANCEL_DATE = "2099-12-31"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# D01
def gift_amount(credit="credit", debit="debit") -> Column:
    return _c(credit) - _c(debit)


# NULL name gives a NULL label (string concatenation propagates NULL)
def partner_label(pid, name) -> Column:
    return F.concat(F.lit("["), _c(pid).cast("string"), F.lit("] "), _c(name))


# D03
def department(choice_name, assigned_name) -> Column:
    return F.coalesce(_c(choice_name), _c(assigned_name), F.lit(UNKNOWN_DEPARTMENT))


def department_id(choice_id, assigned_id) -> Column:
    return F.coalesce(_c(choice_id), _c(assigned_id))


# Register address applies to Belgian partners that use the register
def uses_register(country_id, crab_used) -> Column:
    return (_c(country_id) == BELGIUM) & (_c(crab_used) == F.lit(True))


def street(country_id, crab_used, register_street, own_street) -> Column:
    return F.when(uses_register(country_id, crab_used), _c(register_street)).otherwise(_c(own_street))


def house_number(country_id, crab_used, number) -> Column:
    return F.when(uses_register(country_id, crab_used), _c(number)).otherwise(F.lit(""))


def bus_or_empty(bus) -> Column:
    return F.when(F.length(_c(bus)) > 0, _c(bus)).otherwise(F.lit(""))


def bus_prefixed(bus) -> Column:
    return F.when(F.length(_c(bus)) > 0, F.concat(F.lit("bus "), _c(bus))).otherwise(F.lit(""))


def postcode(country_id, crab_used, register_zip, own_zip) -> Column:
    return F.when(uses_register(country_id, crab_used), _c(register_zip)).otherwise(_c(own_zip))


def municipality(country_id, register_city, own_city) -> Column:
    return F.when(_c(country_id) == BELGIUM, _c(register_city)).otherwise(_c(own_city))


# Province from the first digit run of the postcode (NULL when none)
def zip_number(zip_code) -> Column:
    return F.regexp_substr(_c(zip_code), F.lit("[0-9]+")).try_cast("decimal(38,0)")


def province_from_zip(country_id, zip_code) -> Column:
    n = zip_number(zip_code)
    be = _c(country_id) == BELGIUM
    expr = None
    for lo, hi, label in PROVINCE_ZIP_RANGES:
        cond = be & n.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return (
        expr.when(be, F.lit(WALLONIA))
        .when(_c(country_id) == NETHERLANDS, F.lit(NETHERLANDS_LABEL))
        .when(~_c(country_id).isin(BELGIUM, NETHERLANDS), F.lit(ABROAD))
        .otherwise(F.lit(OTHER))
    )


# Province from the partner's state
def province_from_state(country_id, zip_code, state_name) -> Column:
    cid = F.coalesce(_c(country_id), F.lit(0))
    return (
        F.when((cid == BELGIUM) & (_c(zip_code) == "2070"), F.lit(EAST_FLANDERS))
        .when(cid == BELGIUM, _c(state_name))
        .when(cid == NETHERLANDS, F.lit(NETHERLANDS_LABEL))
        .otherwise(F.lit(ABROAD))
    )


# The most specific analytic dimension wins
def project_of(d1, d2, d3) -> Column:
    return F.coalesce(_c(d3), _c(d2), _c(d1))


# Payment-history project
def history_project(project_nbr, cost_center) -> Column:
    return F.when(_c(cost_center) == "", _c(project_nbr)).otherwise(F.coalesce(_c(cost_center), _c(project_nbr)))


def or_empty(x) -> Column:
    return F.coalesce(_c(x), F.lit(""))


# No opt-out (NULL or false) means consent
def consent(opt_out) -> Column:
    return F.when(_c(opt_out) == F.lit(True), F.lit(NO)).otherwise(F.lit(YES))


# D08
def salutation(gender, title_shortcut) -> Column:
    return F.when(_c(gender) == "M", F.lit("Dhr.")).when(_c(gender) == "V", F.lit("Mevr.")).otherwise(_c(title_shortcut))


# D09: ';' is the export separator, line breaks become spaces
def clean_text(x) -> Column:
    return F.translate(_c(x), ";\n\r", ",  ")


def clean_separator(x) -> Column:
    return F.translate(_c(x), ";", ",")


# D10
def certificate_flag(code) -> Column:
    return F.when(_c(code) == CERTIFICATE_ACCOUNT, F.lit(True)).otherwise(F.lit(False))


# D11
def posting_type(move_name) -> Column:
    return F.when(F.lower(F.coalesce(_c(move_name), F.lit(""))).contains("div"), F.lit(CORRECTION)).otherwise(
        F.lit(NORMAL)
    )


# D12 (named "private gift" in the extracts, but 1 marks organisations)
def organisation_flag(organisation_type, corporation_type) -> Column:
    return (
        F.when(F.coalesce(_c(organisation_type), F.lit(0)) > 0, F.lit(1))
        .when(F.coalesce(_c(corporation_type), F.lit(0)) > 0, F.lit(1))
        .otherwise(F.lit(0))
    )


# D13
def donor_class(organisation_type, corporation_type) -> Column:
    expr = F.when(_c(organisation_type).isin(*INTERNAL_ORGANISATIONS), F.lit(INTERNAL))
    for label, (lo, hi) in DONOR_CLASSES:
        expr = expr.when(_c(corporation_type).between(lo, hi), F.lit(label))
    return expr.otherwise(F.lit(PRIVATE))


# Amount band; refunds fall in band 1, NULL stays NULL
def amount_band(amount) -> Column:
    a = _c(amount)
    return F.when(a < 250, F.lit(1)).when(a.between(250, 1000), F.lit(2)).when(a > 1000, F.lit(3))


# D15
def processing_status(code, posted: bool) -> Column:
    return F.when(_c(code).isin(*GIFT_ACCOUNTS), F.lit(STATUS_POSTED if posted else STATUS_CHECKED)).when(
        _c(code) == SUSPENSE_ACCOUNT, F.lit(STATUS_UNPROCESSED)
    )


# A lifetime single gift is class 1; no profile counts as repeat
def gift_count_class(lifetime_gifts) -> Column:
    return F.when(_c(lifetime_gifts) == 1, F.lit(1)).otherwise(F.lit(2))


# D17
def phone_number(mobile, phone) -> Column:
    return F.coalesce(_c(mobile), _c(phone))


# D18
def year_of(d) -> Column:
    return F.year(_c(d))


def month_of(d) -> Column:
    return F.month(_c(d))


def iso_week_of(d) -> Column:
    return F.weekofyear(_c(d))


# D19
def address_state(x) -> Column:
    return F.coalesce(_c(x), F.lit(0))


def is_deceased(x) -> Column:
    return F.coalesce(_c(x), F.lit(False))


# active partners, and inactive ones only when deceased
def active_or_deceased(active, deceased) -> Column:
    return (_c(active) == F.lit(True)) | ((_c(active) == F.lit(False)) & is_deceased(deceased))


# D23
def month_label(month) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), _c(month).cast("int"))


# D24: "street number/bus"; a NULL part after the street makes the line NULL
def mailing_line(street_col, number, bus) -> Column:
    num = _c(number)
    b = _c(bus)
    return F.concat(
        _c(street_col),
        F.when(F.length(F.coalesce(num, F.lit("_"))) > 0, F.concat(F.lit(" "), num)).otherwise(F.lit("")),
        F.when(F.length(F.coalesce(b, F.lit("_"))) > 0, F.concat(F.lit("/"), b)).otherwise(F.lit("")),
    )


# D27: 'ja' when a matching row was found (its key differs from the sentinel)
def found_flag(x, sentinel) -> Column:
    return F.when(F.coalesce(_c(x), F.lit(sentinel)) == F.lit(sentinel), F.lit("neen")).otherwise(F.lit("ja"))


# Whole months between two dates, calendar style (a month counts once
# the day of month is reached); years are whole months div 12
def whole_months(start, end) -> Column:
    s, e = _c(start), _c(end)
    return (F.year(e) * 12 + F.month(e)) - (F.year(s) * 12 + F.month(s)) - F.when(
        F.dayofmonth(e) < F.dayofmonth(s), F.lit(1)
    ).otherwise(F.lit(0))


def whole_years(start, end) -> Column:
    m = whole_months(start, end)
    # truncation toward zero, like the interval's year field
    return F.when(m >= 0, F.floor(m / 12)).otherwise(-F.floor(-m / 12)).cast("int")


# Per-year rate; the divisor is the year span, undivided within one year
def per_year(total, first_year, last_year) -> Column:
    span = (_c(last_year) - _c(first_year)).cast("double")
    return F.when(_c(last_year) == _c(first_year), _c(total).cast("double")).otherwise(
        F.try_divide(_c(total).cast("double"), span)
    )


# Not cancelled on the given day
def not_cancelled(cancel_date, on_day) -> Column:
    return F.coalesce(_c(cancel_date), F.lit(NO_CANCEL_DATE).cast("date")) >= F.lit(on_day).cast("date")


def never_cancelled(cancel_date) -> Column:
    return F.coalesce(_c(cancel_date), F.lit(NO_CANCEL_DATE).cast("date")) == F.lit(NO_CANCEL_DATE).cast("date")


# May be contacted by post
def contactable_by_post(overleden="overleden", adres_status="adres_status", post="post_ontvangen",
                        hidden="nooit_contacteren") -> Column:
    return (
        (_c(overleden) == "false")
        & (_c(adres_status).cast("decimal(38,0)") != 2)
        & (_c(post) == YES)
        & (F.coalesce(_c(hidden), F.lit("false")) == "false")
    )


def bool_text(x) -> Column:
    """Boolean as the text 'true' / 'false' (NULL stays NULL)."""
    return _c(x).cast("string")
