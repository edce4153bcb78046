"""Calendar of first number ones, mapped onto a target year.

For each (provider, chart, artist, song) the earliest date at rank 1 is
moved to the same month/day of the target year (Feb 29 becomes Feb 28 when
the target year is common) and labelled with its ISO week number.  Provider
is grouped on but not shown, so equal chart names from two providers give
two rows.  ISO weeks put Jan 1-3 in week 52/53 of the year before and Dec
29-31 possibly in week 1; the ordering follows the week number.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toplist.functions.dates import is_leap_col
from toplist.operators.lookup import CHART_KEYS, exact_filters

_ORDER = ["week", "date", "original_date", "event"]


def first_number_ones(
    index: DataFrame, provider: str | None = None, chart: str | None = None
) -> DataFrame:
    """``provider, chart, artist, song, original_date``: first date at #1.

    The rank filter runs before the aggregate (pushed to the scan); one
    partial+final aggregate on the four keys.
    """
    ones = exact_filters(index.where(F.col("this_week") == 1), provider, chart)
    return ones.groupBy(*CHART_KEYS).agg(F.min("date").alias("original_date"))


def _event() -> Column:
    # Null-propagating concat: a null name gives a null event.
    return F.concat(
        F.col("song"), F.lit(" by "), F.col("artist"), F.lit(" reaches #1 on the "), F.col("chart")
    )


def _in_year(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """The same month and day in ``year``; 29 February is the 28th in common years."""
    m = F.month("original_date") if month is None else month
    d = F.dayofmonth("original_date") if day is None else day
    return F.make_date(year, m, F.when(~is_leap_col(year) & (m == 2) & (d == 29), F.lit(28)).otherwise(d))


def ones_calendar(
    index: DataFrame,
    provider: str | None = None,
    chart: str | None = None,
    year: int | None = None,
    today: date | None = None,
) -> DataFrame:
    """``week, date, original_date, event`` for the target year (default: this year)."""
    target = year if year is not None else (today or date.today()).year
    firsts = first_number_ones(index, provider, chart)
    mapped = firsts.withColumn("date", _in_year(F.lit(target)))
    return mapped.select(
        F.weekofyear("date").alias("week"), "date", "original_date", _event().alias("event")
    ).orderBy(*_ORDER)


def calendar_batch(
    index: DataFrame,
    years: DataFrame | list[int],
    provider: str | None = None,
    chart: str | None = None,
    year_col: str = "year",
) -> DataFrame:
    """:func:`ones_calendar` for a table (or list) of target years from one scan and one aggregate.

    Each distinct year is laid out as the 366 (month, day) pairs an entry can
    have, with the date each falls on; first number ones meet it in one
    equi-join on (month, day).  Null years match nothing; years repeated in the
    table give one calendar.  Undated songs appear once per year, without date.
    Output (in no order): ``target_year`` plus the calendar columns.
    """
    spark = index.sparkSession
    if not isinstance(years, DataFrame):
        years = spark.createDataFrame([(int(y),) for y in years], f"{year_col} int")
    distinct = years.select(F.col(year_col).cast("int").alias("target_year")).where("target_year is not null").distinct()
    # The days of a leap year, and one undated place.
    days = F.concat(
        F.transform(
            F.sequence(F.lit(0), F.lit(365)),
            lambda i: F.struct(
                F.month(F.date_add(F.lit(date(2000, 1, 1)), i)).alias("m"),
                F.dayofmonth(F.date_add(F.lit(date(2000, 1, 1)), i)).alias("d"),
            ),
        ),
        F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("d"))),
    )
    targets = distinct.select("target_year", F.inline(days)).withColumn(
        "date", F.when(F.col("m") > 0, _in_year(F.col("target_year"), F.col("m"), F.col("d")))
    )
    firsts = first_number_ones(index, provider, chart).withColumns(
        {
            "m": F.coalesce(F.month("original_date"), F.lit(0)),
            "d": F.coalesce(F.dayofmonth("original_date"), F.lit(0)),
        }
    )
    return firsts.join(targets, ["m", "d"]).select(
        "target_year", F.weekofyear("date").alias("week"), "date", "original_date", _event().alias("event")
    )
