"""A chart-entry feed derived from the TPC-H style tables of a data directory.

The data directory holds sales, not charts, so charts are derived from them:
a provider per region, a chart per (region, part type), an "artist" per part
brand and a "song" per part name, ranked by units shipped in each chart period.

* provider  = region name, lower-case, spaces as ``-``
* chart     = ``<provider>-<lower(p_type)>``
* frequency = monthly for ECONOMY/MEDIUM, fortnightly for PROMO, else weekly
* date      = the period's chart date: Saturday of the (Monday-start) ship
  week, the 1st of the month, or the 1st/15th (``snap=False`` keeps the raw
  ship date, which is how Feb 29 entries reach the calendar tests)
* artist    = by ``p_partkey % 4``: ``The <brand>``, ``<brand> feat. <nation>``,
  ``Éd <brand>`` or ``<brand>``
* song      = ``<p_name> (Remix)`` when ``p_size % 3 = 0``, else ``p_name``
* this_week = rank by units desc, then artist, song within (chart, date); every entry is ranked

Plan shape: line items cannot be pre-aggregated before the part join (the
chart period depends on the part type); join strategies are the planner's and
AQE's choice.  One partial+final aggregate on the chart key.  A chart date of
any size is ranked without gathering it: entries are counted per (chart, date,
units), the counts -- one row per distinct number of units -- are summed from
the top, and only entries with equal units are numbered by name in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toplist.sources.tables import read_table


def _period_date(frequency: F.Column, ship_date: F.Column) -> F.Column:
    month_start = F.trunc(ship_date, "month")
    # Spark weekday(): 0 = Monday; Monday-start week + 5 days = Saturday.
    saturday = F.date_add(F.date_sub(ship_date, F.weekday(ship_date)), 5)
    half = F.date_add(month_start, F.when(F.dayofmonth(ship_date) <= 14, 0).otherwise(14))
    return (
        F.when(frequency == "weekly", saturday)
        .when(frequency == "monthly", month_start)
        .otherwise(half)
    )


def rank_entries(entries: DataFrame) -> DataFrame:
    """``entries`` with ``this_week``: 1 for the most ``units`` of a (chart, date), ties by artist, song."""
    counts = entries.groupBy("chart", "date", "units").agg(F.count("*").alias("_n"))
    above = Window.partitionBy("chart", "date").orderBy(F.desc("units")).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("chart", "date", "units", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    equal = Window.partitionBy("chart", "date", "units").orderBy("artist", "song")
    ranked = entries.join(places, ["chart", "date", "units"]).withColumn("_place", F.row_number().over(equal))
    return ranked.withColumn("this_week", (F.col("_above") + F.col("_place")).cast("bigint")).drop("_above", "_place")


def chart_feed(spark: SparkSession, data_dir: str, snap: bool = True) -> DataFrame:
    """Chart entries ``provider, chart, frequency, date, artist, song, this_week``."""
    lineitem = read_table(spark, data_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
    )
    part = read_table(spark, data_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size"
    )
    supplier = read_table(spark, data_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, data_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, data_dir, "region").select("r_regionkey", "r_name")

    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    supplier_geo = supplier.join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "n_name", "r_name"
    )

    joined = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        supplier_geo, F.col("l_suppkey") == F.col("s_suppkey")
    )

    frequency = (
        F.when(F.col("p_type").isin("ECONOMY", "MEDIUM"), "monthly")
        .when(F.col("p_type") == "PROMO", "fortnightly")
        .otherwise("weekly")
    )
    ship_date = F.to_date("l_shipdate")
    date = _period_date(frequency, ship_date) if snap else ship_date
    key4 = (F.col("p_partkey") % 4).cast("int")
    # Group on the raw columns the names are made of (the mapping to names is
    # one-to-one; the nation only enters "feat." names), so the strings are
    # built once per group instead of once per line item.
    units = joined.groupBy(
        "r_name",
        "p_type",
        date.alias("date"),
        key4.alias("k4"),
        "p_brand",
        F.when(key4 == 1, F.col("n_name")).alias("feat"),
        "p_name",
        (F.col("p_size") % 3 == 0).alias("remix"),
    ).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("units"))

    provider = F.lower(F.regexp_replace("r_name", " ", "-"))
    artist = (
        F.when(F.col("k4") == 0, F.concat(F.lit("The "), "p_brand"))
        .when(F.col("k4") == 1, F.concat("p_brand", F.lit(" feat. "), "feat"))
        .when(F.col("k4") == 2, F.concat(F.lit("Éd "), "p_brand"))
        .otherwise(F.col("p_brand"))
    )
    song = F.when(F.col("remix"), F.concat("p_name", F.lit(" (Remix)"))).otherwise(F.col("p_name"))
    units = units.select(
        provider.alias("provider"),
        F.concat(provider, F.lit("-"), F.lower("p_type")).alias("chart"),
        frequency.alias("frequency"),
        "date",
        artist.alias("artist"),
        song.alias("song"),
        "units",
    )

    return rank_entries(units).select(
        "provider", "chart", "frequency", "date", "artist", "song", "this_week"
    )
