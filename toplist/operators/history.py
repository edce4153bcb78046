"""What chart files carry beside the rank, derived from the index: last week, peak so far, weeks on chart, runs.

An entry is followed by provider, chart, artist and song.  Weeks are counted in
*published dates* of its chart, whatever its frequency, so a missing issue is
not a gap.  An entry's unbroken stays are islands: published dates numbered per
chart, less the entry's own count, are constant inside a stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toplist.operators.lookup import CHART_KEYS

HISTORY_COLUMNS = ["last_week", "peak_position", "weeks_on_chart", "run", "weeks_in_run"]


def chart_history(index: DataFrame) -> DataFrame:
    """``provider, chart, date, this_week, artist, song`` and :data:`HISTORY_COLUMNS` of every index row.

    ``last_week``: its rank on the chart's preceding date; null for a new entry
    and for a re-entry.  ``peak_position``: its best rank up to this date.
    ``weeks_on_chart``: dates it has been on the chart, this one included and
    earlier stays too.  ``run``: number of the stay, from 1; ``weeks_in_run``:
    dates of this stay.  An entry that stands twice on one date counts with its
    best rank, and both rows get the same answer; ranks that are null are no
    ranks, but the date counts.  Rows without date, artist or song cannot be
    followed and have nulls; their dates still count as published.
    """
    dates = index.where(F.col("date").isNotNull()).select("provider", "chart", "date").distinct()
    numbered = dates.withColumn(
        "place", F.row_number().over(Window.partitionBy("provider", "chart").orderBy("date"))
    )
    key = [*CHART_KEYS, "date"]
    followed = index.where("date is not null and artist is not null and song is not null")
    stays = followed.groupBy(*key).agg(F.min("this_week").alias("rank")).join(numbered, ["provider", "chart", "date"])
    # An entry's rows: at most one per date of its chart.
    own = Window.partitionBy(*CHART_KEYS).orderBy("place")
    before = F.lag("place").over(own)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    told = stays.select(
        *key, "place", "rank",
        F.when(before == F.col("place") - 1, F.lag("rank").over(own)).alias("last_week"),
        F.min("rank").over(so_far).alias("peak_position"),
        F.row_number().over(own).cast("bigint").alias("weeks_on_chart"),
        F.when(before == F.col("place") - 1, 0).otherwise(1).alias("starts"),
    ).withColumn("run", F.sum("starts").over(so_far))
    told = told.withColumn(
        "weeks_in_run", F.row_number().over(Window.partitionBy(*CHART_KEYS, "run").orderBy("place")).cast("bigint")
    )
    rows = index.select("provider", "chart", "date", "this_week", "artist", "song")
    # Null keys meet nothing, which is what they should get.
    return rows.join(told.select(*key, *HISTORY_COLUMNS), key, "left").select(
        "provider", "chart", "date", "this_week", "artist", "song", *HISTORY_COLUMNS
    )
