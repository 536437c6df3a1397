"""Key sets sent into the scans of the posting trace, and the way beyond their bound."""

import pytest

from donorlens import params as Q
from donorlens.operators import trace as TR
from donorlens.plans.joins import only_keys
from donorlens.sources import ParquetTables
from donorlens.sources.testdata import TABLES
from tests.plan_metrics import scans
from tests.test_store import same


@pytest.fixture(scope="module")
def erp(spark, tmp_path_factory):
    """The tables as files with the moves in order, in small row groups."""
    from donorlens.sources import TestdataTables
    from tests.conftest import MEDIUM

    root, t = str(tmp_path_factory.mktemp("erp")), TestdataTables.for_session(spark, MEDIUM)
    for name in TABLES:
        rows = t.table(name)
        if "move_id" in rows.columns:
            rows = rows.repartitionByRange(8, "move_id").sortWithinPartitions("move_id")
        rows.write.parquet(f"{root}/{name}")
    return ParquetTables(spark, root)


def test_named_postings_read_few_lines(spark, erp):
    named = TR.posting_lines(erp, Q.TRACE_NAMES)
    named.collect()
    (rows,) = scans(named, "/account_move_line]")
    assert 0 < rows < erp.account_move_line.count() / 4


@pytest.mark.parametrize("report", [TR.posting_lines, TR.posting_trace, TR.posting_analytic_lines])
def test_beyond_the_bound_the_rows_are_the_same(erp, report):
    assert same(report(erp, Q.TRACE_NAMES), report(erp, Q.TRACE_NAMES, key_limit=1))


def test_no_keys_no_rows(spark):
    fact = spark.range(10)
    assert only_keys(fact, "id", spark.range(0)).count() == 0
    assert only_keys(fact, "id", spark.createDataFrame([(None,), (3,)], "k long")).count() == 1
    assert only_keys(fact, "id", spark.range(5), limit=2).count() == 5
