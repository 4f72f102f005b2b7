"""Month arithmetic on whole-number month indexes: year * 12 + month - 1."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def month_start(day: Column) -> Column:
    return F.trunc(day, "month").cast("date")


def month_of(index: Column) -> Column:
    """The first of the month with that index."""
    return F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))


def months_after(day: Column, months: Column | int) -> Column:
    """First of the month so many after the day's."""
    return month_of(month_index(day) + (months if isinstance(months, Column) else F.lit(months)))


def months_between(start: Column, end: Column) -> Column:
    """Whole calendar months, days of the month left aside."""
    return month_index(end) - month_index(start)


def cutoff_of(forecast_date: Column) -> Column:
    """The last day whose publications a forecast of that date may see: the day before."""
    return F.date_sub(forecast_date, 1)


def last_complete_month(day: Column) -> Column:
    """First day of the latest month that has ended on the day."""
    return F.when(F.last_day(day) == day, month_start(day)).otherwise(months_after(day, -1))


def local_day(at: Column, zone: str = "America/New_York") -> Column:
    """The calendar day of a UTC timestamp in a zone."""
    return F.from_utc_timestamp(at, zone).cast("date")


def one_hot(value: Column, values: range, prefix: str) -> list[Column]:
    return [(value == k).cast("double").alias(f"{prefix}_{k}") for k in values]
