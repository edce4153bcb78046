"""Set-valued anniversary and calendar equal their one-date / one-year forms."""

from datetime import date, timedelta

from toplist.operators.anniversary import anniversary_batch, anniversary_hits
from toplist.operators.calendar import calendar_batch, ones_calendar


def test_anniversary_batch_equals_single(spark, six):
    refs = [date(2023, 12, 24) + timedelta(days=i) for i in range(0, 40, 3)]
    refs += [date(2024, 1, 7), date(2024, 1, 20), date(1990, 1, 7), date(2020, 12, 31)]
    rdf = spark.createDataFrame([(d,) for d in refs], "ref_date date")
    got = sorted(tuple(r) for r in anniversary_batch(six, rdf).collect())
    want = sorted(
        (d, *tuple(r)) for d in refs for r in anniversary_hits(six, d.isoformat()).collect()
    )
    assert got == want


def test_anniversary_batch_rank(spark, six):
    rdf = spark.createDataFrame([(date(2024, 1, 7),)], "ref_date date")
    assert anniversary_batch(six, rdf, rank=2).count() == 0


def test_calendar_batch_equals_single(six):
    got = sorted(tuple(r) for r in calendar_batch(six, [2023, 2024]).collect())
    want = sorted(
        (y, *tuple(r)) for y in (2023, 2024) for r in ones_calendar(six, year=y).collect()
    )
    assert got == want


def test_calendar_of_a_table_of_years(spark, six):
    years = spark.createDataFrame([(2023,), (2024,), (2024,), (None,), (1900,)], "year int")
    got = sorted(tuple(r) for r in calendar_batch(six, years).collect())
    want = sorted((y, *tuple(r)) for y in (1900, 2023, 2024) for r in ones_calendar(six, year=y).collect())
    assert got == want


def test_anniversary_batch_repeats_dates_and_skips_nulls(spark, six):
    day = date(2024, 1, 7)
    rdf = spark.createDataFrame([(day,), (day,), (None,)], "ref_date date")
    assert anniversary_batch(six, rdf).count() == 2 * anniversary_hits(six, day.isoformat()).count()


def test_invalid_date_matches_nothing(six):
    hits = anniversary_hits(six, "1999-02-30")
    assert hits.count() == 0 and hits.columns == anniversary_hits(six, "1999-02-28").columns


def test_week_days_follow_the_rule(spark):
    from pyspark.sql import functions as F

    from toplist.functions.dates import week_days_col

    days = [date(2023, 1, 1) + timedelta(days=i) for i in range(0, 3 * 366)]
    df = spark.createDataFrame([(d,) for d in days], "r date")
    for row in df.select("r", week_days_col(F.col("r")).alias("days")).collect():
        start = row["r"] - timedelta(days=(row["r"].weekday() + 1) % 7)
        s, e = start.timetuple().tm_yday, (start + timedelta(days=6)).timetuple().tm_yday
        assert row["days"] == (list(range(s, e + 1)) if s <= e else [*range(s, 367), *range(1, e + 1)])


def _anniversary_brute(rows, ref, rank=1):
    """The matching rule written out directly, one entry at a time."""
    start = ref - timedelta(days=(ref.weekday() + 1) % 7)
    s, e = start.timetuple().tm_yday, (start + timedelta(days=6)).timetuple().tm_yday
    half = 1 if ref.day <= 14 else 15
    out = []
    for prov, chart, freq, d, wk, artist, song in rows:
        if wk != rank or d is None or d.year > ref.year:
            continue
        doy = d.timetuple().tm_yday
        weekly = freq == "weekly" and ((s <= doy <= e) if s <= e else (doy >= s or doy <= e))
        monthly = freq == "monthly" and d.month == ref.month
        fortnightly = freq == "fortnightly" and d.month == ref.month and d.day == half
        if weekly or monthly or fortnightly:
            out.append((prov, chart, freq, d.year, artist, song, d))
    return sorted(out)


def test_anniversary_matches_brute_force_on_random_entries(spark):
    import random

    from toplist.operators.index import index_entries
    from toplist.schema import ENTRY_SCHEMA

    rng = random.Random(21)
    rows = []
    for i in range(600):
        d = date(1988, 1, 1) + timedelta(days=rng.randint(0, 365 * 14))
        freq = rng.choice(["weekly", "monthly", "fortnightly", "yearly"])
        rows.append(("p", f"c{i % 5}", freq, d, rng.choice([1, 1, 2]), f"a{i}", f"s{i}"))
    idx = index_entries(spark.createDataFrame(rows, ENTRY_SCHEMA)).cache()
    refs = [date(2023, 12, 24) + timedelta(days=k) for k in range(0, 16)]
    refs += [date(1996, 2, 29), date(1999, 12, 31), date(2000, 1, 1), date(1992, 7, 15)]
    for ref in refs:
        got = sorted(tuple(r) for r in anniversary_hits(idx, ref.isoformat()).collect())
        assert got == _anniversary_brute(rows, ref), ref
    rdf = spark.createDataFrame([(d,) for d in refs], "ref_date date")
    got = sorted(tuple(r) for r in anniversary_batch(idx, rdf).collect())
    assert got == sorted((ref, *r) for ref in refs for r in _anniversary_brute(rows, ref))
