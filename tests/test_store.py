"""Stored ledger and profile: loads, hot partners, plans, data skipping."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from donorlens import params as Q
from donorlens.functions import rules as R
from donorlens.operators import categories as CAT
from donorlens.operators import certificates as CERT
from donorlens.operators import ledger_reports as LR
from donorlens.operators import profile as PRO
from donorlens.plans import ledger as L
from donorlens.plans import store as S
from donorlens.plans.facts import DIM_KEYS
from donorlens.sources import TestdataTables
from tests.conftest import SMALL
from tests.plan_metrics import scans, sent
from tests.test_plans import facts_read, plan

PERIOD = ("1996-11-01", "1997-02-28")


def same(a, b):
    return a.exceptAll(b.select(a.columns)).count() == 0 and b.exceptAll(a.select(b.columns)).count() == 0


@pytest.fixture(scope="module")
def whole(spark):
    """One load of four months, with hot partners of their own."""
    store = S.LedgerStore(spark, buckets=2, hot_rows=8)
    store.load(TestdataTables.for_session(spark, SMALL), *PERIOD)
    return store


def files_of(store, table, **partition):
    folder = "/".join(f"{k}={v}" for k, v in partition.items())
    return sorted(map(os.path.basename, glob.glob(f"{store.root.removeprefix('file:')}/{table}/{folder}/*.parquet")))


def test_the_months_of_a_period():
    assert S.months("1996-11-15", "1997-02-01") == [(1996, 11), (1996, 12), (1997, 1), (1997, 2)]
    assert list(map(str, S.whole_months("1996-02-10", "1996-02-11"))) == ["1996-02-01", "1996-02-29"]


def test_overlapping_loads_give_one_load_and_touch_only_their_months(spark, tables, whole):
    parts = S.LedgerStore(spark, buckets=2, hot_rows=8)
    parts.load(tables, "1996-11-05", "1996-12-20")  # whole months are loaded
    before = files_of(parts, "facts", branch="active", jaar=1996, maand=11)
    parts.load(tables, "1996-12-01", "1997-02-28")
    assert files_of(parts, "facts", branch="active", jaar=1996, maand=11) == before
    assert same(parts.ledger().wide(), whole.ledger().wide())
    assert same(whole.ledger(*PERIOD).wide(), L.gift_ledger(tables, *PERIOD).wide())
    parts.load(tables, "1996-12-01", "1996-12-31")
    assert same(parts.ledger("1996-12-01", "1997-01-15").wide(), L.gift_ledger(tables, "1996-12-01", "1997-01-15").wide())


def test_an_emptied_month_and_a_changed_successor(spark, tables):
    class Changed:
        def __init__(self, **frames):
            self.frames = frames

        def __getattr__(self, name):
            if name == "memo":  # its plans are of the unchanged tables
                raise AttributeError(name)
            return self.frames[name] if name in self.__dict__["frames"] else getattr(tables, name)

    store = S.LedgerStore(spark, buckets=2)
    store.load(tables, "1996-11-01", "1996-12-31")
    lines = tables.account_move_line
    gone = Changed(account_move_line=lines.where("date < DATE '1996-12-01'"),
                   res_partner_payment_history=tables.res_partner_payment_history.limit(0))
    store.load(gone, "1996-12-01", "1996-12-31")
    assert store.ledger("1996-12-01", "1996-12-31").facts.count() == 0
    assert store.ledger("1996-11-01", "1996-11-30").facts.count() > 0
    partners = tables.res_partner.withColumn("active", F.lit(False)).withColumn("active_partner_id", F.lit(3).cast("long"))
    moved = Changed(res_partner=partners)
    store.remap(moved)
    assert same(store.ledger("1996-11-01", "1996-11-30").facts.where("branch = 'moved'"),
                L.branch_ledger(moved, "1996-11-01", "1996-11-30", "moved").facts)


def test_hot_partners_have_a_table_of_their_own(whole, tables):
    hot = whole.tables.read("hot_facts").where("partner_id IS NOT NULL").select("partner_id").distinct()
    cold = whole.tables.read("facts").where("partner_id IS NOT NULL").select("partner_id").distinct()
    assert hot.count() > 0 and hot.intersect(cold).count() == 0
    led = L.gift_ledger(tables, *PERIOD)
    for report in (LR.unique_donors, LR.project_totals, CERT.fiscal_certificates):
        assert same(report(whole.ledger(*PERIOD)), report(led))
    assert same(LR.ledger_lookup(whole.ledger(*PERIOD), partner_id=5), LR.ledger_lookup(led, partner_id=5))


def test_a_reopened_store_has_the_loaded_months(spark, whole):
    again = S.LedgerStore(spark, root=whole.root, buckets=2)
    rows = L.GiftLedger(whole.tables.read("facts")).facts
    again._create_facts(rows)
    assert same(again.tables.read("facts"), rows)


def test_bucketed_gifts_and_partners_meet_without_a_shuffle(spark, whole):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        text = plan(LR.unique_donors(whole.ledger(*PERIOD)))
        bucketed = text.split("Union")[1].split("_hot_facts")[0]
        join = bucketed[bucketed.index("SortMergeJoin"):bucketed.index("_partners[")]
        assert "_facts[" in join and "Bucketed: true" in join and "Exchange" not in join
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_a_larger_load_makes_more_buckets(spark, tables):
    store = S.LedgerStore(spark, buckets=2, hot_rows=8, bucket_rows=20)
    store.load(tables, *PERIOD)
    stored = store._stored().count()
    assert store.buckets >= stored / 20 > 2
    sizes = store.tables.read("facts").where("partner_id IS NOT NULL").groupBy(F.expr(f"pmod(hash(partner_id), {store.buckets})")).count().agg(F.max("count")).first()[0]
    assert sizes < stored / 4  # with two buckets: half of them
    assert same(store.ledger(*PERIOD).wide(), L.gift_ledger(tables, *PERIOD).wide())
    again = S.LedgerStore(spark, root=store.root, buckets=2)
    assert again.buckets == store.buckets
    again.load(tables, "1997-02-01", "1997-03-31")
    assert same(again.ledger("1996-11-01", "1997-03-31").wide(), L.gift_ledger(tables, "1996-11-01", "1997-03-31").wide())


def test_a_load_sends_only_the_projects_that_its_lines_name(spark, tables):
    stored = S.LedgerStore(spark, buckets=2)
    kept = []

    def stage(rows):
        folder, lines = stored._stage(rows)
        kept.append(folder)
        return lines

    facts = L.loaded_facts(tables, *PERIOD, R.GIFT_ACCOUNTS, stage)
    assert same(facts, L.gift_ledger(tables, *PERIOD).facts)
    assert facts_read(facts) == 0 and len(kept) == 1  # the lines come from the stored ones
    named = spark.read.parquet(kept[0]).select(F.explode(F.array(*DIM_KEYS)).alias("id")).where("id IS NOT NULL").distinct().count()
    projects = tables.account_analytic_account.count()
    assert named < projects
    facts.collect()
    rows = sent(facts, "code")
    assert rows and max(rows) == named, (rows, named, projects)


def test_nothing_staged_is_left_of_a_load(whole):
    assert not glob.glob(f"{whole.root.removeprefix('file:')}/staged-*")


def test_the_wide_ledger_reads_buckets_without_a_shuffle(spark, whole):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        text = plan(whole.ledger(*PERIOD).wide())
        bucketed = text.split("Union")[1].split("_hot_facts")[0]
        join = bucketed[bucketed.index("SortMergeJoin"):bucketed.index("_partners[")]
        assert "_facts[" in join and "Bucketed: true" in join and "Exchange" not in join
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_one_partner_is_found_in_few_files(whole):
    every = whole.ledger().facts
    every.collect()
    read = scans(every, "_facts[")
    one = LR.ledger_lookup(whole.ledger(), partner_id=33)
    one.collect()
    few = scans(one, "_facts[")
    assert 0 < sum(few) < sum(read) / 4, (few, read)
    assert "EqualTo(partner_id,33)" in plan(one)


def test_profile_of_stored_years(spark, tables):
    store = S.ProfileStore(spark)
    store.load(tables, 1990, 1997)
    store.load(tables, 1997, 2035)
    profile = PRO.donor_profile(tables, parts=store.partials())
    assert same(profile, PRO.donor_profile(tables))
    assert same(PRO.donor_profile(tables, 5, parts=store.partials()), PRO.donor_profile(tables, 5))
    assert facts_read(profile) == 0
    certificates = CERT.certificate_donors_missing_id(
        tables, Q.CERTIFICATE_AS_OF, Q.CERTIFICATE_PROFILE_SINCE, Q.CERTIFICATE_HISTORY_MONTHS, profile=profile)
    assert facts_read(certificates) == 1
    assert facts_read(CAT.gift_categories(tables, Q.CATEGORY_PERIOD, as_of=Q.CATEGORY_AS_OF, profile=profile)) == 1
    store.load(tables, 1997, 1997)  # again: nothing changes
    assert same(PRO.donor_profile(tables, parts=store.partials()), profile)
    assert profile.count() > 0
