"""Cross-report invariants."""

from pyspark.sql import functions as F

from donorlens import params as Q
from donorlens.operators import categories as CAT
from donorlens.operators import extracts as X
from donorlens.operators import ledger_reports as LR
from donorlens.operators import profile as PRO
from donorlens.operators import recurring as REC
from donorlens.plans.ledger import gift_ledger


def test_statistics_groupings_sum_to_total(tables):
    stats = LR.gift_statistics(gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END))
    rows = stats.collect()
    total = [r for r in rows if r.categorie == "Totaal"][0]
    for cat in ("Per maand", "afdeling", "vzw", "gemeente", "project"):
        part = [r for r in rows if r.categorie == cat]
        assert sum(r.aantal for r in part) == total.aantal, cat
    money = [r for r in rows if r.categorie in ("Per maand", "vzw") and r.bedrag is not None]
    assert sum(r.bedrag for r in money if r.bedrag is not None) == 2 * total.bedrag


def test_one_partner_is_filter_of_all(tables):
    pid = Q.ONE_PARTNER
    one = X.gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END, pid)
    all_ = X.gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END).where(F.col("partner_id") == pid)
    assert one.exceptAll(all_).count() == 0 and all_.exceptAll(one).count() == 0


def test_profile_totals_match_ledger_over_all_dates(tables):
    prof = PRO.donor_profile(tables).select("partner_id", "aantalgiften", "totaalgiften")
    ledger = X.gift_ledger(tables, "1900-01-01", "2100-12-31")
    per = ledger.groupBy("partner_id").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    joined = prof.join(per, "partner_id", "full")
    bad = joined.where(
        (F.col("aantalgiften") != F.col("n")) | (F.col("totaalgiften") != F.col("s"))
        | F.col("n").isNull() | F.col("aantalgiften").isNull()
    )
    assert bad.count() == 0


def test_categories_have_no_duplicates(tables):
    cats = CAT.gift_categories(tables, Q.CATEGORY_PERIOD, as_of=Q.CATEGORY_AS_OF)
    assert cats.count() == cats.distinct().count()


def test_recurring_donors_are_window_donors(tables):
    rec = REC.recurring_project_donors(tables, Q.RECURRING_START, Q.RECURRING_END, Q.RECURRING_HISTORY_START)
    donors = REC.window_donors(tables, Q.RECURRING_START, Q.RECURRING_END)
    assert rec.join(donors, F.col("partner_id") == F.col("d_id"), "left_anti").count() == 0
