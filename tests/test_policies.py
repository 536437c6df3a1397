"""Policy cells of the ledger variants and edge cases on hand-made tables."""

import datetime as dt
import glob
import os
import tempfile
from decimal import Decimal

import pytest

from donorlens.operators import categories as CAT
from donorlens.operators import certificates as CERT
from donorlens.operators import extracts as X
from donorlens.operators import ledger_reports as LR
from donorlens.operators import recurring as REC
from donorlens.plans.ledger import gift_ledger
from donorlens.plans.selection import Selection
from donorlens.sources.schemas import SCHEMAS, columns
from donorlens.sources.testdata import LITERALS


class Tables:
    """Tiny ERP database built in the test: every table empty unless given."""

    def __init__(self, spark, **rows):
        self.spark = spark
        self._rows = rows

    def __getattr__(self, name):
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        if name in self._rows:
            data = self._rows[name]
        elif name in LITERALS:
            data = list(LITERALS[name].rows)
        else:
            data = []
        return self.spark.createDataFrame(data, SCHEMAS[name])


def partner(pid, **kw):
    base = {c: None for c, _ in columns("res_partner")}
    base.update(id=pid, name=f"P{pid}", active=True, country_id=21, address_state_id=1)
    base.update(kw)
    return tuple(base[c] for c, _ in columns("res_partner"))


def line(partner_id, day, credit, account=2, move=1, name="gift"):
    return (move, account, partner_id, 1, day, Decimal("0.00"), Decimal(credit), name, None, 1, None, None)


MOVES = [(1, "GIFT/1")]
PROJECTS = [(1, "F-00001", "Project een")]


def test_inactive_deceased_with_successor_appears_twice(spark):
    t = Tables(
        spark,
        res_partner=[partner(1, active=False, deceased=True, active_partner_id=2), partner(2)],
        account_move=MOVES,
        account_analytic_account=PROJECTS,
        account_move_line=[line(1, dt.date(2020, 5, 1), "10.00")],
    )
    rows = gift_ledger(t, "2020-01-01", "2020-12-31").wide().collect()
    assert sorted((r.partner_id, r.inact_partner_id) for r in rows) == [(1, None), (2, 1)]


def test_inactive_alive_partner_only_moved(spark):
    t = Tables(
        spark,
        res_partner=[partner(1, active=False, deceased=False, active_partner_id=2), partner(2)],
        account_move=MOVES,
        account_analytic_account=PROJECTS,
        account_move_line=[line(1, dt.date(2020, 5, 1), "10.00")],
    )
    rows = gift_ledger(t, "2020-01-01", "2020-12-31").wide().collect()
    assert [(r.partner_id, r.inact_partner_id) for r in rows] == [(2, 1)]


def test_marketing_income_keeps_lines_without_partner(spark):
    t = Tables(
        spark,
        res_partner=[partner(1)],
        account_move=MOVES,
        account_analytic_account=PROJECTS,
        account_move_line=[line(None, dt.date(2020, 5, 1), "10.00"), line(1, dt.date(2020, 5, 2), "20.00")],
    )
    inc = X.marketing_income(t, "CST", "2020-01-01", "2020-12-31").collect()
    assert sorted((r.partner_id or 0, r.afdeling, r.email_ontvangen) for r in inc) == [
        (0, "onbekend", "JA"), (1, "onbekend", "JA")]
    gifts = X.gift_ledger(t, "2020-01-01", "2020-12-31").collect()
    assert [r.partner_id for r in gifts] == [1]


def test_history_needs_known_country_in_gift_ledger_only(spark):
    hist = [(1, dt.date(2020, 5, 1), Decimal("5.00"), "x", "F-1", None)]
    t = Tables(spark, res_partner=[partner(1, country_id=None)], res_partner_payment_history=hist)
    assert X.gift_ledger(t, "2020-01-01", "2020-12-31").count() == 0
    assert gift_ledger(t, "2020-01-01", "2020-12-31").wide().count() == 1


def test_union_removes_equal_rows_within_one_branch(spark):
    stmt_line = (1, 1, 1, dt.date(2020, 5, 1), Decimal("10.00"), "gift", 1, None, None)
    t = Tables(
        spark,
        res_partner=[partner(1)],
        account_analytic_account=PROJECTS,
        account_bank_statement_line=[stmt_line, stmt_line],
    )
    rows = CAT.gift_categories(t, "CST", "2020-01-01", "2020-12-31").collect()
    assert len(rows) == 1 and rows[0].giftcatverwerkt == "gecontroleerd" and rows[0].giftcataantal == 2


def test_recurring_row_numbers_follow_project_order(spark):
    # one code, two project names: last row numbers are 2 (name A) and 3 (NULL)
    gifts = spark.createDataFrame(
        [(1, Decimal("1"), "F-1", "A", dt.date(2020, 1, 1)), (1, Decimal("1"), "F-1", "A", dt.date(2021, 3, 1)),
         (1, Decimal("1"), "F-1", None, dt.date(2020, 6, 1))],
        "partner_id long, bedrag decimal(16,2), project_code string, project string, date date",
    )
    got = {r.project: (r.r, r.periode_j, r.periode_m) for r in REC.project_spans(gifts).collect()}
    assert got == {"A": (2, 1, 14), None: (3, 0, 0)}


def test_certificate_threshold_applies_per_staged_row(spark):
    """Staged rows of a partner: this year's gifts with pledges, and the
    yearly mean of a regular donor; each must reach the minimum by itself."""
    def gifts(pid, last, before):
        days = [(dt.date(2021, 2, 1), last), (dt.date(2020, 2, 1), before), (dt.date(2019, 2, 1), before)]
        return [line(pid, day, credit) for day, credit in days if credit]

    t = Tables(
        spark,
        res_partner=[partner(p, tax_certificate=True) for p in (1, 2, 3)] + [partner(4, tax_certificate=True, national_id_nbr="R4")],
        account_move=MOVES,
        account_analytic_account=PROJECTS,
        # 1: 30 this year and a mean of 35: neither counts; 2: 50 this year, mean of 35; 3: 30 this year, mean of 45
        account_move_line=gifts(1, "30.00", "20.00") + gifts(2, "50.00", "10.00") + gifts(3, "30.00", "30.00") + gifts(4, "90.00", None),
    )
    rows = CERT.certificate_donors_missing_id(t, "2021-06-30", 2020).collect()
    assert {r.partner_id: r.bedrag for r in rows} == {2: 50.0, 3: 45.0}


def test_one_donor_may_have_year_gifts_and_a_regular_project(spark):
    """Year to date counts a gift once more when its project is supported regularly."""
    days = [dt.date(2020 + (m // 12), m % 12 + 1, 5) for m in range(4, 18)]  # 14 months up to June 2021
    t = Tables(
        spark,
        res_partner=[partner(1, tax_certificate=True)],
        dwh_partners=[(1, True, False, False, None)],
        account_move=MOVES,
        account_analytic_account=PROJECTS,
        account_move_line=[line(1, day, "3.00") for day in days],
    )
    rec = REC.recurring_project_donors(t, "2021-01-01", "2021-06-30", "2020-05-01").collect()
    assert [(r.bedrag, r.periode_j, r.periode_m, r.r) for r in rec] == [(Decimal("42.00"), 1, 13, 14)]
    rows = CERT.certificate_donors_missing_id(t, "2021-06-30").collect()
    # six gifts this year; thirteen since 30 May 2020, as a regular project; the mean of the two profile years
    assert [(r.partner_id, r.bedrag) for r in rows] == [(1, 6 * 3.0 + 13 * 3.0 + 42.0)]


def test_selection_conditions(spark):
    t = Tables(
        spark,
        res_partner=[partner(1, email="a@x.org", zip="1000"), partner(2, zip="2000"), partner(3, zip="1000", opt_out=True, email="b@x.org")],
        account_move=MOVES,
        account_analytic_account=PROJECTS,
        account_move_line=[line(1, dt.date(2020, 5, 1), "10.00", name="Bank ABC"), line(2, dt.date(2020, 5, 2), "20.00", name=None),
                           line(3, dt.date(2020, 5, 3), "30.00", name="other")],
    )
    led = gift_ledger(t, "2020-01-01", "2020-12-31")

    def found(**conditions):
        return sorted(r.partner_id for r in LR.ledger_lookup(led, selection=Selection(**conditions)).collect())

    assert found() == [1, 2, 3]
    assert found(description_like=("%abc%", "%x")) == [1]
    assert found(description_not_like="Bank%") == [3]  # a missing description is neither like nor unlike
    assert found(with_email=True) == [1, 3] and found(with_email=False) == [2]
    assert found(with_email=True, accepts_email=True) == [1]
    assert found(postcodes=("1000",), dates=("2020-05-03", "2020-05-02")) == [3]
    assert found(codes=("F-00001",), project_pattern="Project%", source="ERP", account="732100") + found(codes=("x",)) in ([1, 2, 3], [])
    assert {r.partner_id for r in LR.thankyou_post(led, Selection(with_email=False)).collect()} == {2}


def test_audit_row_is_appended(spark):
    folder = tempfile.mkdtemp(prefix="donorlens-audit-")
    path = os.path.join(folder, "master_jobs")
    X.append_audit(spark, path, 10, dt.datetime(2024, 1, 2, 3, 4, 5))
    X.append_audit(spark, path, 11, dt.datetime(2024, 1, 2, 3, 4, 6))
    rows = spark.read.parquet(path).orderBy("id").collect()
    assert [r.sproc_id for r in rows] == [10, 11]
    assert glob.glob(os.path.join(path, "*.parquet"))


def test_unknown_period_is_rejected(spark):
    t = Tables(spark)
    with pytest.raises(ValueError):
        X.marketing_income(t, "XYZ")


def _legacy_tables(spark, **partner_kw):
    projects = [(1, "L-00001", "Legaat")]
    return Tables(
        spark,
        res_partner=[partner(1, **partner_kw)],
        account_move=MOVES,
        account_analytic_account=projects,
        account_move_line=[line(1, dt.date(2020, 5, 1), "100.00", account=3)],
    )


def test_legacy_needs_known_country_and_active_or_deceased(spark):
    assert X.legacy_ledger(_legacy_tables(spark), "2020-01-01", "2020-12-31").count() == 1
    assert X.legacy_ledger(_legacy_tables(spark, country_id=None), "2020-01-01", "2020-12-31").count() == 0
    gone = _legacy_tables(spark, active=False, deceased=False)
    assert X.legacy_ledger(gone, "2020-01-01", "2020-12-31").count() == 0
    dead = _legacy_tables(spark, active=False, deceased=True)
    assert X.legacy_ledger(dead, "2020-01-01", "2020-12-31").count() == 1


def test_categories_keep_booked_lines_without_partner(spark):
    t = Tables(
        spark,
        account_move=MOVES,
        account_analytic_account=PROJECTS,
        account_move_line=[line(None, dt.date(2020, 5, 1), "300.00"), line(7, dt.date(2020, 5, 2), "5.00")],
    )
    rows = sorted(CAT.gift_categories(t, "CST", "2020-01-01", "2020-12-31").collect(), key=lambda r: r.bedrag)
    # partner 7 has no partner row: reported like a gift without partner
    assert [(r.partner_id, r.giftcatdonateur, r.giftcataantal, r.giftcatbedrag) for r in rows] == [
        (None, "Private persoon", 2, 1), (None, "Private persoon", 2, 2)]


def test_bus_rules_per_extract(spark):
    hist = [(1, dt.date(2020, 5, 1), Decimal("5.00"), "x", "F-1", None)]
    base = dict(account_move=MOVES, account_analytic_account=PROJECTS,
                account_move_line=[line(1, dt.date(2020, 5, 1), "10.00")], res_partner_payment_history=hist)
    for bus, erp_gift, erp_income, history in (("", "", "", ""), ("B", "B", "bus B", "B"), (None, "", "", None)):
        t = Tables(spark, res_partner=[partner(1, street_bus=bus)], **base)
        gifts = {r.bron: r.bus for r in X.gift_ledger(t, "2020-01-01", "2020-12-31").collect()}
        income = {r.bron: r.bus for r in X.marketing_income(t, "CST", "2020-01-01", "2020-12-31").collect()}
        assert gifts == {"erp": erp_gift, "npca": history}
        assert income == {"erp": erp_income, "npca": history}


def test_mandate_fanout_is_kept_unless_deduplicated(spark):
    from donorlens.operators import certificates as CERT

    orders = [(1, 1, 1, "J", 1, Decimal("50.00"), dt.date(2021, 1, 1), dt.date(2020, 1, 1), dt.date(2020, 1, 1), None)]
    banks = [(1, 1, "BIC", "BE1"), (2, 1, "BIC", "BE2")]
    mandates = [(1, 1, "valid"), (2, 2, "valid")]
    t = Tables(spark, res_partner=[partner(1)], donation_partner_account=orders, res_partner_bank=banks,
               sdd_mandate=mandates)
    assert CERT.annualised_pledges(t, "2020-06-30").first().bedrag == Decimal("100.00")
    assert CERT.annualised_pledges(t, "2020-06-30", dedupe_mandates=True).first().bedrag == Decimal("50.00")


def test_contact_lists_repeat_a_gift_as_often_as_they_hold_it(spark):
    day = dt.date(2020, 5, 1)
    listed = ["a@x.be", "a@x.be", "A@X.be", "", "", None]
    t = Tables(
        spark,
        res_partner=[partner(1, email="a@x.BE"), partner(2), partner(3, email=""), partner(4, email="none@x.be")],
        account_move=MOVES, account_analytic_account=PROJECTS,
        account_move_line=[line(p, day, "10.00") for p in (1, 2, 3, 4)],
        website_users=[(1,), (1,), (4,), (9,)],
        suppression_list=[(e,) for e in listed],
    )
    rows = LR.donor_contact_flags(gift_ledger(t, day, day), t).collect()
    got = sorted((r.partner_id, int(r.bedrag), r.website_gebruiker, r.suppressed) for r in rows)
    # partner 1: twice a user, one spelling listed twice and one once; 2 and 3: the empty address, listed twice
    assert got == [(1, 20, "ja", "ja"), (1, 40, "ja", "ja"), (2, 20, "neen", "ja"), (3, 20, "neen", "ja"), (4, 10, "ja", "neen")]
