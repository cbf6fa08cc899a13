"""Calendar arithmetic on Julian days and on year, month, day columns. No year 0: the year before 1 is -1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_JULIAN_DAY = 2440588  # of 1970-01-01
NATIVE = ("@#DGREGORIAN@", "@#DJULIAN@")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
# The last day (month * 100 + day) of each sign, in calendar order; Capricornus also ends the year.
ZODIAC_ENDS = ((119, "Capricornus"), (218, "Aquarius"), (320, "Pisces"), (420, "Aries"), (521, "Taurus"), (621, "Gemini"), (722, "Cancer"), (822, "Leo"), (922, "Virgo"), (1022, "Libra"), (1122, "Scorpio"), (1220, "Sagittarius"), (1231, "Capricornus"))
PERIODS = (25, 50, 100, 250, 500, 1000, 2500, 5000)


def date_of(julian_day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (julian_day - EPOCH_JULIAN_DAY).cast("int"))


def julian_day(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")) + EPOCH_JULIAN_DAY


def year_of(date: Column) -> Column:
    y = F.year(date)
    return F.when(y <= 0, y - 1).otherwise(y)


def event_year(calendar: Column, year: Column, julian: Column) -> Column:
    """Year of a dated row: its own for the Gregorian and Julian calendars, else that of its Julian day."""
    return F.when(calendar.isin(*NATIVE), year).otherwise(year_of(date_of(julian)))


def event_month(calendar: Column, month: Column, julian: Column) -> Column:
    return F.when(calendar.isin(*NATIVE), month).otherwise(F.month(date_of(julian)))


def event_day(calendar: Column, day: Column, julian: Column) -> Column:
    return F.when(calendar.isin(*NATIVE), day).otherwise(F.dayofmonth(date_of(julian)))


def whole_years(first: Column, second: Column) -> Column:
    """Anniversaries between two dates, in whichever order they come."""
    a, b = F.least(first, second), F.greatest(first, second)
    before = (F.month(b) * 100 + F.dayofmonth(b)) < (F.month(a) * 100 + F.dayofmonth(a))
    return year_of(b) - year_of(a) - before.cast("int")


def whole_months(first: Column, second: Column) -> Column:
    a, b = F.least(first, second), F.greatest(first, second)
    return 12 * (year_of(b) - year_of(a)) + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")


def _div(a: Column, b: int) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", a, F.lit(b))


def century(year: Column) -> Column:
    return F.when(year < 0, -(_div(-year - 1, 100) + 1)).otherwise(F.when(year == 0, 1).otherwise(_div(year - 1, 100) + 1)).cast("int")


def decade(year: Column) -> Column:
    return (_div(year, 10) * 10).cast("int")


def zodiac(month: Column, day: Column) -> Column:
    """Sign of a month and day; null where there is none."""
    at, out = month * 100 + day, None
    for end, sign in ZODIAC_ENDS:
        out = F.when(at <= end, sign) if out is None else out.when(at <= end, sign)
    return F.when(month.between(1, 12) & day.between(1, 31), out)


def period_start(year: Column, width: int) -> Column:
    return F.when(year < 0, -(_div(-year - 1, width) + 1) * width).otherwise(_div(year, width) * width).cast("int")


def pick_period(low: int, high: int, rows: int = 20) -> int:
    """The least period of the ladder, and of its last rung's doublings, that covers low..high in at most `rows` rows."""

    def start(year: int, width: int) -> int:
        return -((-year - 1) // width + 1) * width if year < 0 else year // width * width

    k, width = 0, PERIODS[0]
    while (start(high, width) - start(low, width)) // width + 1 > rows:
        k += 1
        width = PERIODS[k] if k < len(PERIODS) else width * 2
    return width
