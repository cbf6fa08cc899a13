import pytest
from pyspark.sql import functions as F

from kinweave.functions import calendar
from kinweave.sources import gedcom


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "years", "months"), [("2000-02-29", "2025-02-28", 24, 299), ("2000-02-29", "2025-03-01", 25, 300), ("1900-05-05", "1900-05-05", 0, 0), ("1950-06-10", "1949-06-11", 0, 11), ("1899-12-31", "1900-01-01", 0, 0)])
def test_spans(spark, a, b, years, months):
    x, y = (F.lit(d).cast("date") for d in (a, b))
    assert value(spark, calendar.whole_years(x, y)) == years
    assert value(spark, calendar.whole_months(x, y)) == months


@pytest.mark.parametrize(("year", "century", "decade"), [(1, 1, 0), (100, 1, 100), (101, 2, 100), (1900, 19, 1900), (1901, 20, 1900), (-1, -1, 0), (-50, -1, -50), (-55, -1, -50), (-100, -1, -100), (-101, -2, -100), (0, 1, 0)])
def test_periods(spark, year, century, decade):
    assert value(spark, calendar.century(F.lit(year))) == century
    assert value(spark, calendar.decade(F.lit(year))) == decade


def test_year_before_year_one(spark):
    assert value(spark, calendar.year_of(calendar.date_of(F.lit(1703161)))) == -51
    assert value(spark, calendar.event_year(F.lit("@#DJULIAN@"), F.lit(-50), F.lit(1703161))) == -50


@pytest.mark.parametrize(("md", "sign"), [((3, 21), "Aries"), ((4, 20), "Aries"), ((4, 21), "Taurus"), ((12, 20), "Sagittarius"), ((12, 21), "Capricornus"), ((1, 19), "Capricornus"), ((1, 20), "Aquarius"), ((3, 20), "Pisces")])
def test_zodiac(spark, md, sign):
    assert value(spark, calendar.zodiac(F.lit(md[0]), F.lit(md[1]))) == sign


def test_heatmap_periods(spark):
    assert calendar.pick_period(1700, 2000) == 25
    assert calendar.pick_period(1000, 2000) == 100
    assert value(spark, calendar.period_start(F.lit(-1), 25)) == -25
    assert value(spark, calendar.period_start(F.lit(1999), 25)) == 1975


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("@#DHEBREW@ 1 TSH 5661", [("@#DHEBREW@", 5661, 1, 1, 2415287, 2415287)]),
        ("@#DFRENCH R@ 1 VEND 1", [("@#DFRENCH R@", 1, 1, 1, 2375840, 2375840)]),
        ("12 JAN 1700/01", [("@#DGREGORIAN@", 1701, 1, 12, 2342349, 2342349)]),
        ("BET 1850 AND MAR 1860", [("@#DGREGORIAN@", 1850, 0, 0, 2396759, 2397123), ("@#DGREGORIAN@", 1860, 3, 0, 2400471, 2400501)]),
        ("nonsense", []),
        ("", []),
    ],
)
def test_dates(text, expected):
    assert gedcom.parse_date(text) == expected
