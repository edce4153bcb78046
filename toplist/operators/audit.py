"""Audit of an index against its charts' metadata: missing issues, missing and repeated ranks, oversized charts.

A chart's size changes over time; the size in force on a date comes from
validity periods (:func:`chart_sizes` reads them from the providers' metadata).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toplist.sources.catalog import chart_catalog, read_metadata

FINDING_COLUMNS = ["provider", "chart", "date", "problem", "this_week", "entries"]
_HISTORY = "array<struct<start:string,end:string,size:bigint>>"


def chart_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``provider, chart, start, end, size``: validity periods from the metadata below ``root``; null: open.

    The periods of ``size_history`` as they are, and the chart's present
    ``size`` after the last of them ends (over the chart's whole life where
    there is no history).
    """
    custom = lambda key, kind: F.variant_get(F.col("chart.custom")[key], "$", kind)
    charts = chart_catalog(read_metadata(spark, root)).select(
        "provider", F.col("chart.prefix").alias("chart"), F.col("chart.start_date").alias("first"),
        F.col("chart.end_date").alias("last"), custom("size", "bigint").alias("size"),
        F.coalesce(custom("size_history", _HISTORY), F.array().cast(_HISTORY)).alias("history"),
    )
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    past = charts.select("provider", "chart", F.inline("history")).select(
        "provider", "chart", day("start").alias("start"), day("end").alias("end"), "size"
    )
    until = F.array_max(F.transform("history", lambda h: h["end"]))
    now = charts.where("size is not null").select(
        "provider", "chart",
        F.coalesce(F.date_add(day(until), 1), day("first")).alias("start"), day("last").alias("end"), "size",
    )
    return past.unionByName(now)


def sizes_in_force(dates: DataFrame, sizes: DataFrame) -> DataFrame:
    """``dates`` (``provider, chart, date``) with the ``size`` in force; null without one.

    Of periods that overlap the one that starts last counts, then the smaller
    size.  An interval join: the chart is the equality, the period a condition.
    """
    inside = (F.coalesce(F.col("start") <= F.col("date"), F.lit(True))) & (
        F.coalesce(F.col("date") <= F.col("end"), F.lit(True))
    )
    valid = dates.join(sizes, ["provider", "chart"]).where(inside & F.col("size").isNotNull())
    latest = valid.groupBy("provider", "chart", "date").agg(
        F.max(F.struct(F.coalesce("start", F.lit("0001-01-01").cast("date")), -F.col("size"))).alias("last")
    )
    return dates.join(
        latest.select("provider", "chart", "date", (-F.col("last.col2")).alias("size")), ["provider", "chart", "date"], "left"
    )


def expected_dates(dates: DataFrame) -> DataFrame:
    """``provider, chart, date``: every issue between a chart's first and last one, by its ``frequency``.

    Weekly: every 7 days from the first; monthly: the first of each month;
    fortnightly: the 1st and 15th.  Charts of another frequency have none.
    """
    ends = dates.groupBy("provider", "chart", "frequency").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    day, month = F.expr("interval 7 days"), F.expr("interval 1 month")
    months = F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), month)
    halves = F.flatten(F.transform(months, lambda m: F.array(m, F.date_add(m, 14))))
    spine = (
        F.when(F.col("frequency") == "weekly", F.sequence("lo", "hi", day))
        .when(F.col("frequency") == "monthly", months)
        .when(F.col("frequency") == "fortnightly", halves)
    )
    issues = ends.select("provider", "chart", "lo", "hi", F.explode(spine).alias("date"))
    return issues.where(F.col("date").between(F.col("lo"), F.col("hi"))).select("provider", "chart", "date")


def audit_index(index: DataFrame, sizes: DataFrame) -> DataFrame:
    """Findings about an index: ``provider, chart, date, problem, this_week, entries``, in no order.

    * ``missing date``: an issue of the chart's frequency between its first and
      last one that the index lacks;
    * ``missing rank``: no entry at a rank from 1 to the size in force;
    * ``repeated rank``: ``entries`` rows at one rank;
    * ``over size``: ``entries`` rows at a rank above the size in force.

    Charts and dates without a size in force are checked for dates and repeated
    ranks only; rows without chart, date or rank are not looked at.
    """
    # Entries are counted per rank before anything else, so a chart of any size is a few rows a date.
    ranked = index.where("date is not null and provider is not null and chart is not null")
    counts = ranked.where("this_week is not null").groupBy("provider", "chart", "date", "this_week").agg(
        F.count("*").alias("entries")
    )
    dates = ranked.select("provider", "chart", "frequency", "date").distinct()
    issues = dates.select("provider", "chart", "date").distinct()
    sized = sizes_in_force(issues, sizes)
    none = lambda c: F.lit(None).cast("bigint").alias(c)
    found: list[DataFrame] = []

    def report(rows: DataFrame, problem: str, rank: Column, entries: Column) -> None:
        found.append(rows.select("provider", "chart", "date", F.lit(problem).alias("problem"), rank, entries))

    report(
        expected_dates(dates).join(issues, ["provider", "chart", "date"], "left_anti"),
        "missing date", none("this_week"), none("entries"),
    )
    asked = sized.where("size >= 1").select(
        "provider", "chart", "date", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("size"))).alias("this_week")
    )
    report(
        asked.join(counts, ["provider", "chart", "date", "this_week"], "left_anti"),
        "missing rank", F.col("this_week"), none("entries"),
    )
    report(counts.where("entries > 1"), "repeated rank", F.col("this_week"), F.col("entries"))
    report(
        counts.join(sized, ["provider", "chart", "date"]).where(F.col("this_week") > F.col("size")),
        "over size", F.col("this_week"), F.col("entries"),
    )
    return reduce(DataFrame.unionByName, found)


