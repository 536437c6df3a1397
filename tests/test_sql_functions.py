"""SQL table functions: arguments, push-down, periods, lateral calls."""

import pytest

from donorlens import params as Q
from donorlens.operators import extracts as X
from donorlens.operators import profile as PRO
from donorlens.sql_functions import register_functions
from tests.conftest import SMALL
from tests.test_plans import plan
from tests.test_store import same


@pytest.fixture(scope="module", autouse=True)
def functions(spark):
    from donorlens.sources import TestdataTables

    return register_functions(spark, TestdataTables.for_session(spark, SMALL))


def scan_conditions(df):
    """The conditions right above the scans, after optimization."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter (" in line]


def test_arguments_reach_the_scans(spark):
    one = spark.sql("SELECT * FROM gift_ledger(33, DATE '1996-03-01', DATE '1996-03-31')")
    (lines,) = [c for c in scan_conditions(one) if "l_shipdate" in c]
    assert ">= 1996-03-01" in lines and "< 1996-04-01" in lines
    assert any("user_id" in c and "= 33" in c for c in scan_conditions(one)) and any("c_custkey" in c and "= 33" in c for c in scan_conditions(one))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate,1996-03-01" in plan(one)
    year = spark.sql("SELECT * FROM marketing_income('YTD', NULL, NULL, as_of => DATE '1997-05-06')")
    (lines,) = [c for c in scan_conditions(year) if "l_shipdate" in c]
    assert ">= 1997-01-01" in lines and "< 1997-05-07" in lines


def test_no_partner_means_all(spark, tables):
    every = X.gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END)
    for partner in ("NULL", "0", "-1"):
        assert same(spark.sql(f"SELECT * FROM gift_ledger({partner}, DATE '{Q.LEDGER_START}', DATE '{Q.LEDGER_END}')"), every)


def test_arguments_may_be_columns(spark, tables):
    tables.newsletter.createOrReplaceTempView("readers")
    got = spark.sql("SELECT r.partner_id AS reader, p.* FROM readers AS r, LATERAL donor_profile(r.partner_id) AS p")
    assert got.where("reader <> partner_id").count() == 0
    assert same(got.drop("reader"), PRO.donor_profile(tables).join(tables.newsletter, "partner_id", "left_semi"))
    assert spark.sql("SELECT * FROM donor_profile(-7)").count() == 0


@pytest.mark.parametrize("call", ["gift_categories('XXX')", "gift_categories('YTD')", "marketing_income('CST', NULL, DATE '1997-01-01')"])
def test_unknown_periods_and_missing_days_are_errors(spark, call):
    with pytest.raises(Exception, match="unknown period code"):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_outer_conditions_join_in(spark):
    by_place = spark.sql(f"SELECT gemeente, sum(amount) AS s FROM gift_ledger(NULL, DATE '{Q.LEDGER_START}', DATE '{Q.LEDGER_END}') WHERE bron = 'npca' GROUP BY 1")
    assert "lineitem.parquet" not in plan(by_place) and by_place.count() > 0
