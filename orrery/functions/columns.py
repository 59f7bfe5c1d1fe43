"""Column expressions shared by the layers; all are built-ins and safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def month_label(day: str) -> Column:
    """yyyy-MM; the empty string for a null day, as joined labels of nulls are."""
    return F.concat_ws("-", F.year(day).cast("string"), two_digits(F.month(day)))


def week_label(day: str) -> Column:
    """ISO year and ISO week, so that 2016-01-01 is in 2015-53; empty for a null day."""
    iso_year = F.extract(F.lit("YEAROFWEEK"), F.col(day))
    return F.concat_ws("-", iso_year.cast("string"), two_digits(F.weekofyear(day)))


def iso_weekday(day: str) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + 1


def day_number(day: str) -> Column:
    return F.unix_date(F.col(day).cast("date"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole * 100, rounded; null where whole is zero or null."""
    return F.round(F.try_divide(part, whole) * 100, digits)


def ratio_if_positive(part: Column, whole: Column, digits: int = 2) -> Column:
    """percent(), but null unless whole is positive."""
    return F.when(whole > 0, percent(part, whole, digits))


def change_from_previous(value: str, along: WindowSpec) -> Column:
    """Change against the row before, in percent; null on the first row."""
    before = F.lag(value).over(along)
    return percent(F.col(value) - before, before)


def calendar_mean(value: str, day: str, days: int) -> Column:
    """Mean per calendar day of the days up to each row's. Days without a row count as zero;
    where the series is younger than that, the days since its first are the divisor."""
    number = day_number(day)
    recent = Window.orderBy(number).rangeBetween(1 - days, Window.currentRow)
    age = number - F.min(number).over(Window.partitionBy()) + 1
    return F.round(F.try_divide(F.sum(value).over(recent), F.least(age, F.lit(days))))


def row_mean(value: str, along: WindowSpec, rows: int) -> Column:
    """Mean of the last so many rows; periods without a row are not seen."""
    return F.round(F.avg(value).over(along.rowsBetween(1 - rows, Window.currentRow)))


def outside(day: Column, start: Column, end: Column) -> Column:
    """1 if day is certainly outside start..end; 0 otherwise, so also where that can't be told."""
    return F.when((day < start) | (day > end), 1).otherwise(0)


def is_blank(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
