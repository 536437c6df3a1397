"""Map the driver's generated tables onto the ERP / CRM schema.

The driver ships TPC-H-like tables (customer, orders, lineitem, part, events).
Each ERP table below is a projection of one of them (or a small fixed lookup
list).  Every column is a SQL expression that parses identically in Spark SQL
and DuckDB, so the Spark side (``TestdataTables``) and the DuckDB oracle
(``oracle_ctes``) read exactly the same rows.  The Spark side builds each
table with ``select(F.expr(...))`` over a pruned parquet scan: the mapping
adds no shuffle except the lineitem-orders join that supplies the posting
partner and company.
"""

from __future__ import annotations

import weakref
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import columns

C = "c_custkey"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _days(base: str, expr: str) -> str:
    return f"DATE '{base}' + CAST({expr} AS INT)"


@dataclass(frozen=True)
class Mapped:
    """An ERP table projected from one driver table (or an equi-join of two)."""

    name: str
    source: str
    exprs: dict[str, str]
    where: str | None = None
    join: tuple[str, str] | None = None  # (other table, join condition)
    # rows matching ``extra_where`` are emitted once more, with ``extra_exprs``
    # overriding some columns (second bank account, doubled statement lines)
    extra_where: str | None = None
    extra_exprs: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Literal:
    """A small fixed lookup table."""

    name: str
    rows: tuple[tuple, ...]


# --------------------------------------------------------------------------
# Fixed values of the test mapping (ledger account codes and names, bank
# statements, titles, countries).  Account codes 732000/732100 are gifts,
# 734000 legacies, 740500 subsidies, 499010 the suspense account; id 2098 is
# one of the statement accounts the category report excludes.
# --------------------------------------------------------------------------
ACCOUNTS = (
    (1, "732000", "Schenkingen; met attest"),
    (2, "732100", "Schenkingen"),
    (3, "734000", "Legaten"),
    (4, "740500", "Subsidies"),
    (5, "499010", "Wachtrekening"),
    (2098, "732100", "Uitgesloten"),
)
BANK_STATEMENTS = (
    (1, "B-288-1", "draft"),
    (2, "B-288-2", "confirm"),
    (3, "B-100-1", "draft"),
    (4, "C-288-4", "draft"),
)
COMPANIES = ((1, "Vereniging A vzw"), (2, "Beheer B vzw"))
COUNTRIES = (
    (18, "Frankrijk"),
    (19, "Duitsland"),
    (20, "Luxemburg"),
    (21, "België"),
    (22, "Spanje"),
    (23, "Italië"),
    (24, "Portugal"),
    (166, "Nederland"),
)
STATES = (
    (1, "Antwerpen"),
    (2, "Limburg"),
    (3, "Oost-Vlaanderen"),
    (4, "Vlaams-Brabant"),
    (5, "West-Vlaanderen"),
    (6, "Henegouwen"),
    (7, "Luik"),
    (8, "Luxemburg"),
    (9, "Namen"),
)
TITLES = ((1, "Dhr."), (2, "Mevr."), (3, "Fam."))
# every fifth register city lies in the West-Flemish mailing region
REGION_ZIPS = ("8870", "8600", "8900", "8500", "8000", "8800", "8400")


def _cities() -> tuple[tuple, ...]:
    rows = []
    for k in range(1, 40):  # zip_id 40 has no register city
        zip_code = REGION_ZIPS[(k // 5) % len(REGION_ZIPS)] if k % 5 == 0 else str(1000 + (k * 239) % 9000)
        rows.append((k, f"Gemeente {k}", zip_code))
    return tuple(rows)


LITERALS: dict[str, Literal] = {
    t.name: t
    for t in (
        Literal("account_account", ACCOUNTS),
        Literal("account_bank_statement", BANK_STATEMENTS),
        Literal("res_company", COMPANIES),
        Literal("res_country", COUNTRIES),
        Literal("res_country_state", STATES),
        Literal("res_partner_title", TITLES),
        Literal("res_country_city", _cities()),
        Literal("res_country_city_street", tuple((k, f"Registerstraat {k}") for k in range(1, 46))),
        Literal("res_partner_corporation_type", tuple((k, f"Rechtsvorm {k}") for k in range(1, 18))),
    )
}

_EVENT_DATE = _days("1996-01-01", "event_id % 1800")

MAPPED: dict[str, Mapped] = {
    t.name: t
    for t in (
        Mapped(
            "res_partner",
            "customer",
            {
                "id": f"{C} + 1",
                "name": "c_name",
                "first_name": f"CASE WHEN {C} % 6 = 0 THEN NULL ELSE 'V' || {_s(C)} END",
                "last_name": f"CASE WHEN {C} % 10 = 0 THEN NULL ELSE 'A' || {_s(C)} END",
                "active": f"{C} % 7 <> 0",
                "deceased": f"CASE WHEN {C} % 14 = 0 THEN TRUE WHEN {C} % 5 = 0 THEN NULL ELSE FALSE END",
                "active_partner_id": f"CASE WHEN {C} % 21 = 0 THEN {C} + 2 END",
                "membership_state": f"CASE {C} % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'none' WHEN 2 THEN 'invoiced' END",
                "membership_state_b": f"CASE {C} % 3 WHEN 0 THEN 'paid' WHEN 1 THEN 'wait_member' END",
                "membership_nbr": f"CASE WHEN {C} % 5 <> 1 THEN 'M' || {_s(C)} END",
                "membership_cancel": f"CASE WHEN {C} % 9 = 0 THEN {_days('2015-01-01', f'{C} % 2000')} END",
                "membership_cancel_b": f"CASE WHEN {C} % 10 = 3 THEN {_days('2016-01-01', f'{C} % 1000')} END",
                "street": f"CASE WHEN {C} % 19 <> 0 THEN 'Straat ' || {_s(f'{C} % 97')} END",
                "street_id": f"CASE WHEN {C} % 3 = 0 THEN 1 + {C} % 50 END",
                "street_nbr": f"CASE WHEN {C} % 23 <> 0 THEN {_s(f'1 + {C} % 150')} END",
                "street_bus": f"CASE {C} % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'A' ELSE {_s(f'{C} % 4')} END",
                "zip": (
                    f"CASE WHEN {C} % 11 = 0 THEN 'B-' || {_s(f'1000 + ({C} * 37) % 9000')} "
                    f"WHEN {C} % 97 = 0 THEN '2070' WHEN {C} % 13 = 0 THEN NULL "
                    f"WHEN {C} % 17 = 0 THEN 'XX' ELSE {_s(f'1000 + ({C} * 37) % 9000')} END"
                ),
                "zip_id": f"1 + {C} % 40",
                "city": f"CASE WHEN {C} % 29 <> 0 THEN 'Stad ' || {_s(f'{C} % 60')} END",
                "postbus_nbr": f"CASE WHEN {C} % 8 = 3 THEN {_s(f'{C} % 300')} END",
                "crab_used": f"{C} % 3 = 0",
                "country_id": (
                    "CASE WHEN c_nationkey < 15 THEN 21 WHEN c_nationkey < 18 THEN 166 "
                    "WHEN c_nationkey < 24 THEN c_nationkey END"
                ),
                "state_id": f"CASE WHEN {C} % 15 <> 0 THEN 1 + {C} % 10 END",
                "department_id": f"CASE WHEN {C} % 4 <> 0 THEN 1 + {C} % 7 END",
                "department_choice_id": f"CASE WHEN {C} % 10 = 0 THEN 8 + {C} % 3 END",
                "relation_partner_id": f"CASE WHEN {C} % 5 = 2 THEN {C} END",
                "title": f"CASE WHEN {C} % 3 <> 0 THEN 1 + {C} % 4 END",
                "gender": f"CASE {C} % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'V' END",
                "birthday": f"CASE WHEN {C} % 7 <> 3 THEN {_days('1940-01-01', f'({C} * 53) % 20000')} END",
                "national_id_nbr": f"CASE WHEN {C} % 2 = 0 THEN 'R' || {_s(C)} END",
                "address_state_id": f"{C} % 4",
                "opt_out": f"CASE WHEN {C} % 8 = 0 THEN NULL ELSE {C} % 8 = 1 END",
                "opt_out_letter": f"{C} % 9 = 1",
                "iets_te_verbergen": f"CASE WHEN {C} % 31 = 0 THEN NULL ELSE {C} % 13 = 5 END",
                "email": f"CASE WHEN {C} % 4 <> 0 THEN 'Mail' || {_s(C)} || '@x.org' END",
                "email_work": f"CASE WHEN {C} % 3 = 0 THEN 'Work' || {_s(C)} || '@y.org' END",
                "mobile": f"CASE WHEN {C} % 2 = 0 THEN '04' || lpad({_s(C)}, 8, '0') END",
                "phone": f"CASE WHEN {C} % 5 <> 0 THEN '03' || lpad({_s(C)}, 7, '0') END",
                "corporation_type_id": f"CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 + {C} % 17 END",
                "organisation_type_id": f"CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 + {C} % 17 END",
                "tax_certificate": f"{C} % 3 <> 1",
                "company_registration_number": (
                    f"CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'BE0' || {_s(C)} END"
                ),
            },
        ),
        Mapped(
            "account_move",
            "orders",
            {
                "id": "o_orderkey + 1",
                "name": f"CASE WHEN o_orderstatus = 'P' THEN 'DIV/' ELSE 'GIFT/2014/' END || {_s('o_orderkey')}",
            },
        ),
        Mapped(
            "account_move_line",
            "lineitem",
            {
                "move_id": "l_orderkey + 1",
                "account_id": "CASE l_partkey % 8 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 5 ELSE 1 + l_partkey % 2 END",
                "partner_id": (
                    "CASE WHEN l_partkey % 10 = 9 THEN NULL WHEN l_suppkey % 2 = 0 "
                    "THEN 1 + o_custkey % 20 ELSE 1 + o_custkey END"
                ),
                "company_id": "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END",
                "date": "CAST(l_shipdate AS DATE)",
                "debit": "CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END",
                "credit": "CASE WHEN l_returnflag <> 'R' THEN l_quantity * (1 + l_suppkey % 30) ELSE 0 END",
                "name": (
                    f"CASE WHEN l_partkey % 37 = 3 THEN NULL WHEN l_partkey % 23 = 4 THEN 'GIFT/2014/' || {_s('l_orderkey')} "
                    f"ELSE 'gift; line' || chr(10) || {_s('l_linenumber')} END"
                ),
                "ref": f"CASE WHEN l_linenumber % 3 <> 0 THEN 'REF' || {_s('l_orderkey')} END",
                "analytic_dimension_1_id": "1 + l_partkey % 30",
                "analytic_dimension_2_id": "CASE WHEN l_suppkey % 3 = 0 THEN 1 + l_partkey % 5 END",
                "analytic_dimension_3_id": "CASE WHEN l_suppkey % 9 = 0 THEN 1 + l_partkey % 7 END",
            },
            join=("orders", "l_orderkey = o_orderkey"),
        ),
        Mapped(
            "account_analytic_account",
            "part",
            {
                "id": "p_partkey + 1",
                "code": (
                    "CASE WHEN p_type LIKE 'LARGE%' THEN 'L-' ELSE 'F-' END || "
                    f"lpad({_s('p_partkey % 4')}, 5, '0')"
                ),
                "name": (
                    "CASE WHEN p_partkey % 11 = 0 THEN ' Bos voor IEDEREEN' "
                    "WHEN p_partkey % 11 = 1 THEN 'bos voor iedereen  ' ELSE p_name END"
                ),
            },
        ),
        Mapped(
            "res_partner_payment_history",
            "events",
            {
                "partner_id": "user_id + 1",
                "date": _EVENT_DATE,
                "amount": "value",
                "description": (
                    f"CASE event_id % 5 WHEN 0 THEN 'MangoPay SA NP exp;' || {_s('event_id')} "
                    f"WHEN 1 THEN 'mangopay sanp donation SA ANT ' || {_s('event_id')} "
                    f"WHEN 2 THEN 'Gift' || chr(13) || 'npca ' || {_s('event_id')} "
                    f"WHEN 3 THEN NULL ELSE 'Koalect sa lim ' || {_s('event_id')} END"
                ),
                "project_nbr": "CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN 'F-00001' WHEN 2 THEN '' ELSE 'F-00002' END",
                "cost_center": "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'F-00003' END",
            },
            where="event_type = 'purchase'",
        ),
        Mapped(
            "account_bank_statement_line",
            "events",
            {
                "statement_id": "1 + event_id % 4",
                "account_id": "CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 3 ELSE 2098 END",
                "partner_id": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id + 1 END",
                "date": _EVENT_DATE,
                "amount": "value",
                "name": f"'Overschrijving;' || {_s('event_id')} || chr(10) || 'gift'",
                "analytic_dimension_1_id": "1 + event_id % 30",
                "analytic_dimension_2_id": "CASE WHEN event_id % 3 = 0 THEN 1 + event_id % 5 END",
                "analytic_dimension_3_id": "CASE WHEN event_id % 9 = 0 THEN 1 + event_id % 7 END",
            },
            where="event_type = 'signup'",
            extra_where="event_type = 'signup' AND event_id % 50 = 0",
        ),
        Mapped(
            "donation_partner_account",
            "customer",
            {
                "id": f"{C} + 1",
                "partner_id": f"{C} + 1",
                "analytic_account_id": f"1 + {C} % 30",
                "interval_type": f"CASE WHEN {C} % 8 = 0 THEN 'J' ELSE 'M' END",
                "interval_number": "1",
                "donation_amount": f"CASE WHEN {C} % 24 = 8 THEN -5 ELSE 5 END * (1 + {C} % 20)",
                "next_invoice_date": _days("2020-06-01", f"({C} * 37) % 900"),
                "donation_start": _days("2018-01-01", f"{C} % 700"),
                "last_invoice_date": _days("2019-06-01", f"({C} * 37) % 900"),
                "donation_cancel": f"CASE WHEN {C} % 12 = 0 THEN {_days('2021-01-01', f'{C} % 2000')} END",
            },
            where=f"{C} % 4 = 0",
        ),
        Mapped(
            "donation_donation_line",
            "events",
            {
                "partner_id": "user_id + 1",
                "amount_total": "5 * (1 + user_id % 20) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END",
                "date_invoice": f"CASE WHEN event_id % 997 <> 5 THEN {_days('2019-01-01', 'event_id % 700')} END",
                "invoice_id": "event_id",
            },
            where="event_type = 'click'",
        ),
        Mapped(
            "res_partner_bank",
            "customer",
            {
                "id": f"{C} + 1",
                "partner_id": f"{C} + 1",
                "bank_bic": f"'BIC' || {_s(f'{C} % 10')}",
                "acc_number": f"'BE' || lpad({_s(C)}, 14, '0')",
            },
            extra_where=f"{C} % 40 = 0",
            extra_exprs={"id": f"{C} + 100000001"},
        ),
        Mapped(
            "sdd_mandate",
            "customer",
            {
                "id": f"{C} + 1",
                "partner_bank_id": f"{C} + 1",
                "state": f"CASE WHEN ({C} + 1) % 5 = 0 THEN 'cancel' ELSE 'valid' END",
            },
            extra_where=f"{C} % 40 = 0",
            extra_exprs={
                "id": f"{C} + 100000001",
                "partner_bank_id": f"{C} + 100000001",
                "state": f"CASE WHEN ({C} + 100000001) % 5 = 0 THEN 'cancel' ELSE 'valid' END",
            },
        ),
        Mapped(
            "dwh_partners",
            "customer",
            {
                "partner_id": f"{C} + 1",
                "vrijwilliger": f"{C} % 2 = 0",
                "bestuurder": f"{C} % 5 = 0",
                "conservator": f"{C} % 7 = 0",
                "aankoper": f"CASE WHEN {C} % 11 = 0 THEN TRUE WHEN {C} % 11 = 1 THEN NULL ELSE FALSE END",
            },
            where=f"{C} % 3 <> 2",
        ),
        # some users are listed twice; some addresses twice, some in two spellings, two are empty
        Mapped("website_users", "customer", {"partner_id": f"{C} + 1"}, where=f"{C} % 6 = 0", extra_where=f"{C} % 18 = 0"),
        Mapped(
            "suppression_list",
            "customer",
            {"emailaddress": f"'MAIL' || {_s(C)} || '@X.ORG'"},
            where=f"{C} % 10 = 0",
            extra_where=f"{C} % 30 = 0",
            extra_exprs={
                "emailaddress": f"CASE WHEN {C} IN (60, 120) THEN '' WHEN {C} % 60 = 0 THEN 'MAIL' || {_s(C)} || '@X.ORG' ELSE 'mail' || {_s(C)} || '@X.org' END"
            },
        ),
        Mapped("newsletter", "customer", {"partner_id": f"{C} + 1"}, where=f"{C} % 4 = 1"),
        Mapped(
            "account_move_reconcile",
            "orders",
            {"id": "o_orderkey + 1", "name": f"'B-15-' || {_s('o_orderkey')}"},
            where="o_orderkey % 5 = 0",
        ),
        Mapped(
            "account_move_line_reconcile",
            "orders",
            {"id": "o_orderkey + 1", "move_id": "o_orderkey + 1", "reconcile_id": "o_orderkey + 1"},
            where="o_orderkey % 5 = 0",
        ),
        Mapped(
            "account_invoice",
            "orders",
            {"id": "o_orderkey + 1", "move_id": "o_orderkey + 1"},
            where="o_orderkey % 3 <> 2",
        ),
        Mapped(
            "account_invoice_line",
            "orders",
            {"id": "2 * o_orderkey + 1", "invoice_id": "o_orderkey + 1"},
            extra_where="o_orderkey % 2 = 0",
            extra_exprs={"id": "2 * o_orderkey + 2"},
        ),
        Mapped(
            "membership_membership_line",
            "orders",
            {"id": "o_orderkey + 1", "account_invoice_line": "2 * o_orderkey + 1"},
            where="o_orderkey % 4 = 0",
        ),
        Mapped(
            "account_analytic_line",
            "lineitem",
            {"account_id": "1 + l_partkey % 30", "move_id": "l_orderkey + 1"},
        ),
    )
}

TABLES = tuple(sorted(set(MAPPED) | set(LITERALS)))


def _typed(table: str, exprs: dict[str, str]) -> list[tuple[str, str]]:
    """(column, CAST(expr AS declared type)) in declared column order."""
    return [(name, f"CAST({exprs[name]} AS {typ})") for name, typ in columns(table)]


# ----------------------------------------------------------------- Spark side
class TestdataTables:
    """ERP tables as lazy DataFrames over the driver parquet files.

    ``for_session`` returns one instance per (session, folder) so the lazy
    plans of the mapped tables - and derived plans registered with ``memo``
    (partner dimension, ledgers) - are built once and shared by all reports.
    Nothing is cached as data.
    """

    # keyed by the session object itself: a stopped session's tables are never given to a new one
    _instances: weakref.WeakKeyDictionary[SparkSession, dict[str, TestdataTables]] = weakref.WeakKeyDictionary()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self._memo: dict = {}

    @classmethod
    def for_session(cls, spark: SparkSession, sf_dir: str) -> TestdataTables:
        folders = cls._instances.setdefault(spark, {})
        folder = sf_dir.rstrip("/")
        if folder not in folders:
            folders[folder] = cls(spark, folder)
        return folders[folder]

    def memo(self, key, build):
        """Build-once store for derived lazy plans keyed by ``key``."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._build(name)
        return self._cache[name]

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def _build(self, name: str) -> DataFrame:
        if name in LITERALS:
            # an inline VALUES table is a local relation of known (tiny) size,
            # so the planner broadcasts it instead of shuffling the facts
            return self.spark.sql(table_sql(name))
        spec = MAPPED[name]
        src = self.raw(spec.source)
        if spec.join is not None:
            other, cond = spec.join
            src = src.join(self.raw(other), F.expr(cond))
        out = self._project(src, spec.where, name, spec.exprs)
        if spec.extra_where is not None:
            extra = self._project(src, spec.extra_where, name, {**spec.exprs, **spec.extra_exprs})
            out = out.unionByName(extra)
        return out

    @staticmethod
    def _project(src: DataFrame, where: str | None, name: str, exprs: dict[str, str]) -> DataFrame:
        if where is not None:
            src = src.where(F.expr(where))
        return src.select([F.expr(e).alias(c) for c, e in _typed(name, exprs)])


# ----------------------------------------------------------------- SQL side
def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def table_sql(name: str) -> str:
    """SELECT statement producing one ERP table from the driver views."""
    if name in LITERALS:
        cols = columns(name)
        rows = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in LITERALS[name].rows)
        casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in cols)
        return f"SELECT {casts} FROM (VALUES {rows}) AS v({', '.join(c for c, _ in cols)})"
    spec = MAPPED[name]
    src = spec.source if spec.join is None else f"{spec.source} JOIN {spec.join[0]} ON {spec.join[1]}"

    def one(where: str | None, exprs: dict[str, str]) -> str:
        sel = ", ".join(f"{e} AS {c}" for c, e in _typed(name, exprs))
        return f"SELECT {sel} FROM {src}" + (f" WHERE {where}" if where else "")

    sql = one(spec.where, spec.exprs)
    if spec.extra_where is not None:
        sql += " UNION ALL " + one(spec.extra_where, {**spec.exprs, **spec.extra_exprs})
    return sql


def oracle_ctes() -> str:
    """``name AS (SELECT ...)`` for every ERP table, comma separated."""
    return ",\n".join(f"{name} AS ({table_sql(name)})" for name in TABLES)
