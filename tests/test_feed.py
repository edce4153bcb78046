"""Invariants of the chart feed derived from the sf0.001 tables."""

from pyspark.sql import functions as F

from toplist.sources.feed import chart_feed

SF = "/root/testdata/sf0.001"


def test_ranks_are_contiguous_from_one(spark):
    feed = chart_feed(spark, SF)
    per_date = feed.groupBy("chart", "date").agg(
        F.min("this_week").alias("lo"), F.max("this_week").alias("hi"), F.count("*").alias("n")
    )
    bad = per_date.where((F.col("lo") != 1) | (F.col("hi") != F.col("n")))
    assert bad.count() == 0
    assert feed.select("chart", "date", "artist", "song").distinct().count() == feed.count()


def test_dates_follow_frequency(spark):
    feed = chart_feed(spark, SF)
    wrong = feed.where(
        ((F.col("frequency") == "weekly") & (F.dayofweek("date") != 7))
        | ((F.col("frequency") == "monthly") & (F.dayofmonth("date") != 1))
        | ((F.col("frequency") == "fortnightly") & ~F.dayofmonth("date").isin(1, 15))
    )
    assert wrong.count() == 0
    freqs = {r[0] for r in feed.select("frequency").distinct().collect()}
    assert freqs == {"weekly", "monthly", "fortnightly"}


def test_unsnapped_feed_keeps_ship_dates(spark):
    feed = chart_feed(spark, SF, snap=False)
    assert feed.where(F.dayofweek("date") != 7).count() > 0
    assert feed.schema["this_week"].dataType.typeName() == "long"


def test_one_chart_date_is_ranked_over_several_tasks(spark):
    import random

    from toplist.sources.feed import rank_entries

    rng = random.Random(3)
    rows = [("c", "1999-01-02", rng.randrange(60), f"a{rng.randrange(9)}", f"s{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "chart string, date string, units long, artist string, song string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = rank_entries(df)
        got = {(r["artist"], r["song"]): r["this_week"] for r in ranked.collect()}
        tasks = ranked.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    order = sorted(rows, key=lambda r: (-r[2], r[3], r[4]))
    assert got == {(r[3], r[4]): i + 1 for i, r in enumerate(order)}
    assert tasks > 1
