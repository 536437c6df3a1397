"""Every registered report equals its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tools.check_oracle import rows_of

NAMES = sorted(E.oracle_sql())


def test_every_report_has_an_oracle():
    from donorlens.catalog import QUERIES as REPORTS

    assert set(REPORTS) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck_small, name):
    sdf = E.queries()[name](spark, SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck_small.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(res.columns)
    assert rows_of(srows, sdf.columns) == rows_of(res.fetchall(), res.columns)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.columns) == 55
    assert df.count() >= 0


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "StringType()": "VARCHAR",
                 "DateType()": "DATE", "BooleanType()": "BOOLEAN", "DoubleType()": "DOUBLE"}


def _duck_type(dtype) -> str:
    text = repr(dtype)
    return SPARK_TO_DUCK.get(text) or text.replace("DecimalType", "DECIMAL").replace(" ", "")


@pytest.mark.parametrize("name", NAMES)
def test_column_types_agree(spark, duck_small, name):
    sdf = E.queries()[name](spark, SMALL)
    rel = duck_small.sql(E.oracle_sql()[name])
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {f.name: _duck_type(f.dataType) for f in sdf.schema} == duck
