"""Civil dates: anchored months, inclusive counts and the parsers of dates written as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def month_index(d: Column) -> Column:
    """Months since year 0, whatever the day."""
    return F.year(d) * 12 + F.month(d)


def months_inclusive(start: Column, end: Column) -> Column:
    """How many anchors start + k months lie on or before end; 0 if end is before start."""
    n = month_index(end) - month_index(start)
    return F.when(end < start, F.lit(0)).otherwise(n - F.when(F.add_months(start, n) > end, 1).otherwise(0) + 1)


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(days_inclusive(F.greatest(a_start, b_start), F.least(a_end, b_end)), F.lit(0))


def years_since(day: Column, start: Column) -> Column:
    """Whole years by calendar months since start; 0 before it, null without one."""
    return F.when(start.isNull(), None).when(day < start, 0).otherwise(F.floor((month_index(day) - month_index(start)) / 12))


def first_of_month_on_or_after(d: Column) -> Column:
    return F.when(F.dayofmonth(d) == 1, d).otherwise(F.add_months(F.trunc(d, "MM"), 1))


def first_full_month_after(d: Column) -> Column:
    return F.add_months(F.trunc(d, "MM"), 1)


def excel_serial(d: Column) -> Column:
    return F.datediff(d, F.lit("1899-12-30").cast("date"))


def from_serial(n: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))


def civil(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where there is no such day."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_token(text: Column) -> Column:
    """M/D/YY, M/D/YYYY or ISO; two-digit years to 49 are of this century, others of the last."""
    def token(text: Column) -> Column:
        part = lambda k: F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$", k)
        year = part(3).try_cast("int")
        year = F.when(F.length(part(3)) == 2, F.when(year < 50, year + 2000).otherwise(year + 1900)).otherwise(year)
        slashed = F.when(part(1) != "", civil(year, part(1), part(2)))
        return F.coalesce(slashed, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")))

    return let(text, token)


def parse_named(text: Column) -> Column:
    """January 15, 2030."""
    return F.when(text.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), F.try_to_date(F.initcap(text), "MMMM d, yyyy"))


def parse_cell(text: Column) -> Column:
    """A spreadsheet cell: a serial day number from 1 to 60000, or a date written out."""
    number = text.try_cast("double")
    return F.coalesce(F.when(number.between(1, 60000), from_serial(F.floor(number))), parse_token(text), parse_named(text))
