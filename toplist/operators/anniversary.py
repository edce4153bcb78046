"""Same week in history: entries at a rank in the week/month/fortnight of a date.

Matching rule per chart frequency, relative to a reference date ``ref``:

* weekly: the entry's day of year lies in the Sunday-to-Saturday week of
  ``ref``, the bounds being days of year in their own years (so after Feb 28
  the window drifts by a day between leap and common years, and a week that
  crosses the new year matches ``>= start`` or ``<= end``);
* monthly: same month as ``ref``;
* fortnightly: same month and day exactly 1 (``ref`` day <= 14) or 15;

and always ``this_week = rank`` and ``year <= year(ref)`` (the reference year
included).  Unknown or null frequencies never match.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplist.constants import DEFAULT_ANNIVERSARY_RANK
from toplist.functions.dates import fortnight_day_col, parse_date, week_days_col
from toplist.operators.lookup import empty_like, exact_filters
from toplist.plans.ordering import sorted_result
from toplist.schema import ANNIVERSARY_COLUMNS

_ORDER = ["year", "provider", "chart", "date", "artist", "song"]


def anniversary_hits(
    index: DataFrame,
    date_str: str | None = None,
    rank: int = DEFAULT_ANNIVERSARY_RANK,
    provider: str | None = None,
    chart: str | None = None,
    today: date | None = None,
) -> DataFrame:
    """Entries at ``rank`` in the same week of earlier (and the same) years.

    ``date_str`` empty or ``None`` means today (``today`` overrides the
    clock); a malformed date gives no rows.  A pure filter scan: the year
    bound prunes partitions, the rank reaches the Parquet reader.
    """
    ref = parse_date(date_str) if date_str else today or date.today()
    if ref is None:
        return empty_like(index, ANNIVERSARY_COLUMNS)
    on = F.lit(ref)
    frequency, same_month = F.col("frequency"), F.col("month") == F.month(on)
    # The rule of each frequency on a literal date; its parts fold to constants.
    in_period = (
        F.when(frequency == "weekly", F.array_contains(week_days_col(on), F.dayofyear("date")))
        .when(frequency == "fortnightly", same_month & (F.col("day") == fortnight_day_col(on)))
        .when(frequency == "monthly", same_month)
    )
    df = exact_filters(index, provider, chart).where(
        (F.col("this_week") == rank) & (F.col("year") <= ref.year) & in_period
    )
    return sorted_result(df.select(*ANNIVERSARY_COLUMNS), *_ORDER)


def _period_key(frequency, doy, month, day):
    """(k1, k2) equality key of a chart period; null for an unknown frequency."""
    k1 = (
        F.when(frequency == "weekly", doy)
        .when(frequency.isin("monthly", "fortnightly"), month)
    )
    k2 = F.when(frequency == "fortnightly", day).when(
        frequency.isin("weekly", "monthly"), F.lit(0)
    )
    return k1, k2


def anniversary_batch(
    index: DataFrame,
    refs: DataFrame,
    rank: int = DEFAULT_ANNIVERSARY_RANK,
    provider: str | None = None,
    chart: str | None = None,
    ref_col: str = "ref_date",
) -> DataFrame:
    """:func:`anniversary_hits` for every date in ``refs[ref_col]`` in one join.

    Each reference date is expanded to the period keys it matches -- the
    days of year of its week (a wrapped week gives ``start..366`` and
    ``1..end``), its month, and its (month, 1 or 15) -- tagged by frequency.
    Index rows carry the one key of their own frequency, so the whole rule is
    a single equi-join on ``(frequency, k1, k2)`` with ``year <= ref_year`` as
    the residual condition.  Dates that repeat in ``refs`` are joined once and
    repeated afterwards; the distinct ones are bounded by the calendar, and the
    planner decides how to join them.  Null dates match nothing.
    Output (in no order): ``ref_date`` plus the anniversary columns; one result
    set per reference row.
    """
    counted = refs.where(F.col(ref_col).isNotNull()).groupBy(F.col(ref_col).alias("ref_date")).agg(
        F.count("*").cast("int").alias("_times")
    )
    r = F.col("ref_date")
    week_days = week_days_col(r)
    keys = F.array(
        F.struct(F.lit("monthly").alias("frequency"), F.month(r).alias("k1"), F.lit(0).alias("k2")),
        F.struct(
            F.lit("fortnightly").alias("frequency"),
            F.month(r).alias("k1"),
            fortnight_day_col(r).alias("k2"),
        ),
    )
    weekly_keys = F.transform(
        week_days,
        lambda d: F.struct(F.lit("weekly").alias("frequency"), d.alias("k1"), F.lit(0).alias("k2")),
    )
    expanded = counted.select(
        "ref_date", "_times", F.year(r).alias("ref_year"), F.inline(F.concat(weekly_keys, keys))
    )

    k1, k2 = _period_key(F.col("frequency"), F.dayofyear("date"), F.col("month"), F.col("day"))
    rows = exact_filters(index, provider, chart).where(F.col("this_week") == rank).select(
        *ANNIVERSARY_COLUMNS, k1.alias("k1"), k2.alias("k2")
    )
    joined = rows.join(
        expanded,
        (rows["frequency"] == expanded["frequency"])
        & (rows["k1"] == expanded["k1"])
        & (rows["k2"] == expanded["k2"])
        & (rows["year"] <= expanded["ref_year"]),
    )
    matched = joined.select("ref_date", "_times", *[rows[c] for c in ANNIVERSARY_COLUMNS])
    return matched.withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_time")
