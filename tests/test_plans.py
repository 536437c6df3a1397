"""Physical-plan properties that matter at scale."""

from donorlens import params as Q
from donorlens.operators import certificates as CERT
from donorlens.operators import ledger_reports as LR
from donorlens.operators import recurring as REC
from donorlens.operators import extracts as X
from donorlens.plans.ledger import gift_ledger


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_tables_are_broadcast(tables):
    p = plan(X.gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END))
    assert "LocalTableScan" in p and "BroadcastExchange" in p
    assert "Scan ExistingRDD" not in p


def test_filters_reach_the_scan(tables):
    df = X.gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text


def test_reports_aggregate_before_partner_join(tables):
    led = gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END)
    opt = LR.unique_donors(led)._jdf.queryExecution().optimizedPlan().toString()
    # the first aggregate (per partner, branch, year) sits below the join
    join_at = opt.find("Join Inner")
    assert join_at >= 0 and opt.find("Aggregate", join_at) > join_at


def test_recurring_has_no_window_over_gift_rows(tables):
    df = REC.recurring_project_donors(tables, Q.RECURRING_START, Q.RECURRING_END, Q.RECURRING_HISTORY_START)
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    window_at = opt.find("Window [")
    assert window_at >= 0
    # the window's input is an aggregate (one row per project name)
    assert opt.find("Aggregate", window_at) > window_at


def facts_read(df):
    """Scans of the booked lines; a reused stage counts once."""
    return plan(df).split("== Initial Plan ==")[-1].count("lineitem.parquet")


def test_facts_are_read_as_seldom_as_possible(tables):
    assert facts_read(REC.recurring_project_donors(tables, Q.RECURRING_START, Q.RECURRING_END, Q.RECURRING_HISTORY_START)) == 1
    certificates = CERT.certificate_donors_missing_id(
        tables, Q.CERTIFICATE_AS_OF, Q.CERTIFICATE_PROFILE_SINCE, Q.CERTIFICATE_HISTORY_MONTHS)
    assert facts_read(certificates) == 2


def test_only_the_lookups_of_a_report_are_joined(tables):
    led = gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END)
    joins = {name: df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for name, df in {
        "ledger_dates": LR.ledger_dates(led, "npca"), "thankyou_totals": LR.thankyou_totals(led, Q.THANKYOU_PATTERN),
        "unique_donors": LR.unique_donors(led)}.items()}
    # the ledger's own joins and one with the partners: no partner lookups
    assert joins["ledger_dates"] <= 2 and joins["thankyou_totals"] <= 11 < joins["unique_donors"], joins


def test_branches_read_only_their_tables(tables):
    history = plan(X.ledger_branch(tables, Q.LEDGER_START, Q.LEDGER_END, "history"))
    assert "lineitem.parquet" not in history and "events.parquet" in history
    moved = X.ledger_branch(tables, Q.LEDGER_START, Q.LEDGER_END, "moved")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(CASE" not in moved and "event_id" not in moved
    # the successors meet the lines below the look-ups (deeper in the tree is later in the text)
    assert moved.index("= am_id") < moved.index("= old_id")


def test_income_ledgers_join_the_partners_once(tables):
    for df in (X.gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END), X.gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END, Q.ONE_PARTNER),
               X.marketing_income(tables, Q.MARKETING_PERIOD, Q.MARKETING_START, Q.MARKETING_END)):
        opt = df._jdf.queryExecution().optimizedPlan().toString()
        # the 55 columns are made once, over the union of the narrow gifts
        assert opt.count("Union") >= 1 and opt.count("Join ") <= 17, opt.count("Join ")


def test_legacies_meet_the_moves_after_the_projects(tables):
    opt = X.legacy_ledger(tables, Q.LEGACY_START, Q.LEGACY_END)._jdf.queryExecution().optimizedPlan().toString()
    assert opt.index("= am_id") < opt.index("isnotnull(coalesce(on_1")


def test_enrichment_builds_only_the_readers_attributes(tables):
    led = gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END)
    opt = LR.profile_enrichment(led, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert opt.count("LeftSemi") >= 2
