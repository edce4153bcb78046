"""Bulk lookup of the chart that covers a date: for each (date, chart) the last chart at or before it.

:func:`toplist.operators.lookup.show_chart` takes exact chart dates only.  Here
a table of dates meets the chart dates in an as-of join without a cross
product: both are put in one order by (provider, chart, date), each block of
that order carries the last chart date forward, and what a chart's earlier
blocks end with is carried into its later ones.  A chart with any number of
dates asked is spread over as many blocks as it fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toplist.session import written_once

CHART = ["provider", "chart"]


def covering_dates(index: DataFrame, asked: DataFrame, ref_col: str = "ref_date") -> DataFrame:
    """``ref_date, provider, chart, date``: the last date of the chart at or before each date asked.

    ``asked`` has a date column ``ref_col``, ``provider`` and ``chart``; rows
    that repeat count once.  A date before the chart's first one, and a chart
    that the index lacks, have a null ``date``; rows with a null among the
    three are left out.
    """
    wanted = asked.select(F.col(ref_col).cast("date").alias("ref_date"), *CHART).na.drop().distinct()
    known = index.select(*CHART, "date").where(F.col("date").isNotNull()).distinct()
    # A chart date stands ahead of a question of the same day.
    order = [*CHART, "at", "asks"]
    both = known.select(*CHART, F.col("date").alias("at"), F.lit(0).alias("asks")).unionByName(
        wanted.select(*CHART, F.col("ref_date").alias("at"), F.lit(1).alias("asks"))
    )
    blocks = written_once(
        both.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "covering-blocks"
    )
    charted = F.when(F.col("asks") == 0, F.col("at"))
    ends = blocks.groupBy(*CHART, "block").agg(F.max(charted).alias("last"))
    # One row per block and chart in it.
    earlier = Window.partitionBy(*CHART).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*CHART, "block", F.max("last").over(earlier).alias("carried"))
    inside = Window.partitionBy(*CHART, "block").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    here = blocks.withColumn("here", F.last(charted, ignorenulls=True).over(inside)).where("asks = 1")
    return here.join(carried, [*CHART, "block"]).select(
        F.col("at").alias("ref_date"), *CHART, F.coalesce("here", "carried").alias("date")
    )


def show_covering(
    index: DataFrame, asked: DataFrame, ref_col: str = "ref_date", max_rank: int | None = None
) -> DataFrame:
    """``ref_date, provider, chart, this_week, artist, song, date``: the entries of the covering charts, in no order.

    ``max_rank`` keeps the entries ranked up to it.  Dates without a covering
    chart have no rows.  Chart dates are joined once each; questions with the
    same answer meet them by an equi-join.
    """
    entries = index if max_rank is None else index.where(F.col("this_week") <= max_rank)
    found = covering_dates(index, asked, ref_col).where(F.col("date").isNotNull())
    return found.join(entries.select(*CHART, "date", "this_week", "artist", "song"), [*CHART, "date"]).select(
        "ref_date", *CHART, "this_week", "artist", "song", "date"
    )
