"""Hand-written rule rows (one per edge case) for the shared Column rules."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from donorlens.functions import rules as R
from donorlens.functions.period import months_before, resolve_period


def one(spark, schema, rows, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def test_partner_label(spark):
    assert one(spark, "id long, name string", [(5, "Jan"), (5, None)], R.partner_label("id", "name")) == [
        "[5] Jan", None]


def test_address_rules(spark):
    schema = "c_id int, crab boolean, reg_street string, street string, nbr string, reg_zip string, zip string, reg_city string, city string"
    rows = [
        (21, True, "RegStraat", "Eigen", "7", "9000", "9001", "Gent", "Eigenstad"),   # BE + register
        (21, False, "RegStraat", "Eigen", "7", "9000", "9001", "Gent", "Eigenstad"),  # BE without
        (166, True, "RegStraat", "Eigen", "7", "9000", "9001", "Gent", "Eigenstad"),  # NL + register flag
    ]
    df = spark.createDataFrame(rows, schema)
    got = df.select(
        R.street("c_id", "crab", "reg_street", "street"),
        R.house_number("c_id", "crab", "nbr"),
        R.postcode("c_id", "crab", "reg_zip", "zip"),
        R.municipality("c_id", "reg_city", "city"),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("RegStraat", "7", "9000", "Gent"),
        ("Eigen", "", "9001", "Gent"),
        ("Eigen", "", "9001", "Eigenstad"),
    ]


@pytest.mark.parametrize("country,zip_code,expected", [
    (21, "1000", "Brussel"), (21, "1299", "Brussel"), (21, "1300", "Wallonië"), (21, "1500", "Vlaams Brabant"),
    (21, "2999", "Antwerpen"), (21, "3499", "Vlaams Brabant"), (21, "3500", "Limburg"), (21, "4000", "Wallonië"),
    (21, "8000", "West-Vlaanderen"), (21, "9999", "Oost-Vlaanderen"), (21, "B-2070", "Antwerpen"),
    (21, "XX", "Wallonië"), (21, None, "Wallonië"), (166, "1000", "Nederland"), (5, "1000", "Buitenland niet NL"),
    (None, "1000", "andere"),
])
def test_province_from_zip(spark, country, zip_code, expected):
    assert one(spark, "c int, z string", [(country, zip_code)], R.province_from_zip("c", "z")) == [expected]


def test_province_from_state(spark):
    rows = [(21, "2070", "Antwerpen"), (21, "2000", "Antwerpen"), (166, "1000", None), (None, "1000", "X")]
    assert one(spark, "c int, z string, s string", rows, R.province_from_state("c", "z", "s")) == [
        "Oost-Vlaanderen", "Antwerpen", "Nederland", "Buitenland niet NL"]


def test_projects(spark):
    assert one(spark, "a string, b string, c string", [("a", None, None), ("a", "b", "c")],
               R.project_of("a", "b", "c")) == ["a", "c"]
    assert one(spark, "p string, c string", [("P1", ""), ("P1", None), ("P1", "C")],
               R.history_project("p", "c")) == ["P1", "P1", "C"]


def test_consent_salutation_text(spark):
    assert one(spark, "o boolean", [(None,), (False,), (True,)], R.consent("o")) == ["JA", "JA", "NEEN"]
    assert one(spark, "g string, t string", [("M", "x"), ("V", "x"), (None, "Fam.")],
               R.salutation("g", "t")) == ["Dhr.", "Mevr.", "Fam."]
    assert one(spark, "d string", [("a;b\nc\rd",)], R.clean_text("d")) == ["a,b c d"]


def test_posting_type(spark):
    assert one(spark, "n string", [("X/DIV/1",), ("div",), (None,), ("GIFT/1",)], R.posting_type("n")) == [
        "correctie", "correctie", "normaal (geen correctie)", "normaal (geen correctie)"]


def test_donor_class(spark):
    rows = [(1, None), (2, 5), (None, 13), (None, 14), (None, 16), (None, 17), (None, None)]
    assert one(spark, "o int, c int", rows, R.donor_class("o", "c")) == [
        "Intern", "Vennootschap", "Publiekrechterlijk", "Private persoon", "Stichting", "Vereniging",
        "Private persoon"]


def test_amount_band(spark):
    rows = [(Decimal("249.99"),), (Decimal("250"),), (Decimal("1000"),), (Decimal("1000.01"),), (Decimal("-5"),),
            (None,)]
    assert one(spark, "a decimal(15,2)", rows, R.amount_band("a")) == [1, 2, 2, 3, 1, None]


def test_gift_count_class(spark):
    assert one(spark, "n long", [(1,), (2,), (None,)], R.gift_count_class("n")) == [1, 2, 2]


def test_iso_week(spark):
    rows = [(dt.date(2024, 12, 30),), (dt.date(2021, 1, 1),)]
    assert one(spark, "d date", rows, R.iso_week_of("d")) == [1, 53]
    assert one(spark, "d date", rows, R.year_of("d")) == [2024, 2021]


def test_whole_months(spark):
    rows = [(dt.date(2023, 1, 31), dt.date(2023, 2, 28)), (dt.date(2022, 3, 15), dt.date(2023, 3, 14)),
            (dt.date(2022, 3, 15), dt.date(2023, 3, 15))]
    assert one(spark, "a date, b date", rows, R.whole_months("a", "b")) == [0, 11, 12]
    assert one(spark, "a date, b date", rows, R.whole_years("a", "b")) == [0, 0, 1]


def test_per_year(spark):
    # gifts in 2020 and 2022: 2 gifts, 100 EUR -> 1 gift and 50 EUR per year
    df = spark.createDataFrame([(2020, 2022, 2, 100.0), (2021, 2021, 3, 90.0)], "a int, b int, n long, s double")
    got = df.select(R.per_year("n", "a", "b"), R.per_year("s", "a", "b")).collect()
    assert [tuple(r) for r in got] == [(1.0, 50.0), (3.0, 90.0)]


def test_string_greater_than_zero(spark):
    rows = [("",), ("0",), ("-1",), ("00",), ("P-1",)]
    df = spark.createDataFrame(rows, "p string")
    assert [r[0] for r in df.where(F.col("p") > F.lit("0")).collect()] == ["00", "P-1"]


def test_null_ordering(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r[0] for r in df.orderBy(F.col("x").asc_nulls_last()).collect()] == [1, 2, None]
    assert [r[0] for r in df.orderBy(F.col("x").desc_nulls_first()).collect()] == [None, 2, 1]


def test_mailing_line(spark):
    rows = [("Straat", "7", "A"), ("Straat", "", ""), ("Straat", None, ""), (None, "7", "")]
    assert one(spark, "s string, n string, b string", rows, R.mailing_line("s", "n", "b")) == [
        "Straat 7/A", "Straat", None, None]


def test_periods():
    assert resolve_period("CST", "2020-01-01", "2020-03-31") == (dt.date(2020, 1, 1), dt.date(2020, 3, 31))
    assert resolve_period("YTD", as_of="2021-06-30") == (dt.date(2021, 1, 1), dt.date(2021, 6, 30))
    with pytest.raises(ValueError):
        resolve_period("XYZ", as_of="2021-06-30")
    assert months_before("2024-03-31", 13) == dt.date(2023, 2, 28)
    assert months_before("2024-01-15", 13) == dt.date(2022, 12, 15)
