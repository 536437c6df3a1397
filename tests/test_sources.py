"""Real-data source path and ledger materialisation."""

import os
import tempfile

from donorlens import params as Q
from donorlens.operators import extracts as X
from donorlens.operators import ledger_reports as LR
from donorlens.plans.ledger import gift_ledger
from donorlens.sources import ParquetTables
from donorlens.sources.testdata import TABLES
from tools.check_oracle import rows_of


def test_parquet_tables_give_the_same_reports(spark, tables):
    root = tempfile.mkdtemp(prefix="donorlens-erp-")
    for name in TABLES:
        tables.table(name).write.mode("overwrite").parquet(os.path.join(root, name))
    erp = ParquetTables(spark, root)
    for build in (lambda t: X.gift_ledger(t, Q.LEDGER_START, Q.LEDGER_END),
                  lambda t: X.marketing_income(t, "CST", Q.MARKETING_START, Q.MARKETING_END)):
        a, b = build(tables), build(erp)
        assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
        assert rows_of([tuple(r) for r in a.collect()], a.columns) == rows_of([tuple(r) for r in b.collect()], b.columns)


def test_materialized_ledger_gives_the_same_report(spark, tables):
    led = gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END)
    stored = led.materialize(spark)
    a, b = LR.unique_donors(led), LR.unique_donors(stored)
    assert rows_of([tuple(r) for r in a.collect()], a.columns) == rows_of([tuple(r) for r in b.collect()], b.columns)
    assert spark.sparkContext.getCheckpointDir()


def test_report_export_is_semicolon_text(spark, tables):
    from donorlens.sources.sinks import export_report

    df = X.gift_ledger(tables, Q.LEDGER_START, Q.LEDGER_END).select("partner_id", "description", "bus")
    path = os.path.join(tempfile.mkdtemp(prefix="donorlens-export-"), "gifts")
    export_report(df, path)
    back = spark.read.option("sep", ";").option("header", "true").csv(path)
    assert back.columns == ["partner_id", "description", "bus"]
    assert back.count() == df.count()


def test_reports_as_sql_views(spark):
    from donorlens.catalog import register_views
    from tests.conftest import SMALL

    register_views(spark, SMALL, ["gift_ledger", "donor_profile"], prefix="v_")
    one = spark.sql(f"SELECT COUNT(*) AS n FROM v_gift_ledger WHERE partner_id = {Q.ONE_PARTNER}").first().n
    direct = X.gift_ledger(spark_tables(spark), Q.LEDGER_START, Q.LEDGER_END, Q.ONE_PARTNER).count()
    assert one == direct
    assert spark.sql("SELECT COUNT(*) AS n FROM v_donor_profile").first().n > 0


def spark_tables(spark):
    from donorlens.sources import TestdataTables
    from tests.conftest import SMALL

    return TestdataTables.for_session(spark, SMALL)


def test_configure_leaves_static_settings_alone(spark, monkeypatch):
    from donorlens import session

    monkeypatch.setitem(session.DEFAULTS, "spark.python.sql.dataFrameDebugging.enabled", "false")
    monkeypatch.setitem(session.DEFAULTS, "spark.sql.catalogImplementation", "in-memory")
    session.configure(spark)  # must not raise on static settings
