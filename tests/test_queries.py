"""The six-row fixture and its expected outputs (reference tests plus hand traces)."""

from datetime import date

from conftest import artists, events

from toplist.operators.anniversary import anniversary_hits
from toplist.operators.calendar import ones_calendar
from toplist.operators.lookup import best_rank_in_year, search_hits, show_chart
from toplist.schema import (
    ANNIVERSARY_COLUMNS,
    BEST_COLUMNS,
    CALENDAR_COLUMNS,
    SEARCH_ROW_COLUMNS,
    SHOW_COLUMNS,
)


def test_anniversary_week_match(six):
    df = anniversary_hits(six, "2024-01-07")
    assert df.columns == ANNIVERSARY_COLUMNS
    assert artists(df) == ["Artist A", "Artist C", "Artist D"]


def test_anniversary_sorted_by_year(six):
    years = [r["year"] for r in anniversary_hits(six, "2024-01-07").collect()]
    assert years == sorted(years)


def test_anniversary_wrapped_week(six):
    assert artists(anniversary_hits(six, "2023-12-31")) == ["Artist B"]


def test_anniversary_today_fallback(six):
    assert "Artist A" in artists(anniversary_hits(six, None, today=date(2024, 1, 7)))
    assert "Artist A" in artists(anniversary_hits(six, "", today=date(2024, 1, 7)))


def test_anniversary_invalid_date(six):
    df = anniversary_hits(six, "not-a-date")
    assert df.count() == 0
    assert df.columns == ANNIVERSARY_COLUMNS


def test_anniversary_rank_and_filters(six):
    assert anniversary_hits(six, "2024-01-07", rank=2).count() == 0
    assert artists(anniversary_hits(six, "2024-01-07", provider="p3")) == ["Artist D"]
    assert artists(anniversary_hits(six, "2024-01-07", chart="c2")) == ["Artist C"]


def test_anniversary_reference_year_included(six):
    # 1990-01-07 itself is in its own week and year.
    assert "Artist A" in artists(anniversary_hits(six, "1990-01-07"))
    assert anniversary_hits(six, "1989-01-07").count() == 0


def test_anniversary_fortnight_second_half(six):
    assert artists(anniversary_hits(six, "2024-01-20")) == ["Artist C", "Artist E"]


def test_search_provider_filter(six):
    df = search_hits(six, provider="p1")
    assert df.columns == SEARCH_ROW_COLUMNS
    assert artists(df) == ["Artist A", "Artist B", "Leap Artist"]
    assert artists(search_hits(six, provider="p2")) == ["Artist C"]


def test_search_chart_filter(six):
    assert search_hits(six, chart="c1").count() == 3
    assert search_hits(six, chart="c3").count() == 2
    assert search_hits(six, provider="p1", chart="c1").count() == 3
    assert search_hits(six, provider="p1", chart="c2").count() == 0


def test_search_empty_strings_mean_no_filter(six):
    assert search_hits(six, provider="", chart="", artist="").count() == 6


def test_search_fuzzy(six):
    assert artists(search_hits(six, artist="Leap Artst")) == ["Leap Artist"]
    assert artists(search_hits(six, artist="Leap Artst", provider="p1")) == ["Leap Artist"]
    assert search_hits(six, artist="Leap Artst", provider="p2").count() == 0
    assert artists(search_hits(six, artist="Leap Artst", chart="c1")) == ["Leap Artist"]
    assert artists(search_hits(six, artist="Artist A")) == [
        "Artist A",
        "Artist B",
        "Artist C",
        "Artist D",
        "Artist E",
    ]


def test_search_song_and_artist(six):
    assert artists(search_hits(six, song="Leap Snog")) == ["Leap Artist"]
    assert artists(search_hits(six, artist="Leap Artst", song="Leap Snog")) == ["Leap Artist"]
    assert search_hits(six, artist="Artist A", song="Leap Song").count() == 0
    assert search_hits(six, song="Completely different").count() == 0


def test_search_query_normalising_to_empty_matches_short_names(spark, six):
    # "(x)" normalises to "" and is applied: names of length <= 2 only.
    assert search_hits(six, artist="(x)").count() == 0


def test_search_date_and_year(six):
    assert artists(search_hits(six, date_str="1990-01-01")) == ["Artist C", "Artist D"]
    assert artists(search_hits(six, year=1991)) == ["Artist B"]
    # date wins over year
    assert artists(search_hits(six, date_str="1990-01-01", year=1991)) == ["Artist C", "Artist D"]
    bad = search_hits(six, date_str="1990-13-01")
    assert bad.count() == 0 and bad.columns == SEARCH_ROW_COLUMNS


def test_search_best_mode(six):
    df = search_hits(six, provider="p1", best_position=True)
    assert df.columns == BEST_COLUMNS
    rows = df.collect()
    assert len(rows) == 3
    assert all(r["best_rank"] == 1 for r in rows)
    # best mode is ignored when a date is given
    assert search_hits(six, date_str="1990-01-07", best_position=True).columns == SEARCH_ROW_COLUMNS


def test_peak_year(six):
    df = best_rank_in_year(six, 1990, 10)
    assert df.columns == BEST_COLUMNS
    assert artists(df) == ["Artist A", "Artist C", "Artist D", "Artist E"]
    assert {r["best_rank"] for r in df.collect()} == {1}


def test_show_chart(six):
    df = show_chart(six, "1990-01-01")
    assert df.columns == SHOW_COLUMNS
    assert artists(df) == ["Artist C", "Artist D"]
    assert show_chart(six, "1990-01-02").count() == 0
    assert show_chart(six, "not-a-date").count() == 0
    assert artists(show_chart(six, "1990-01-01", provider="p3")) == ["Artist D"]


def test_calendar_2024(six):
    df = ones_calendar(six, year=2024)
    assert df.columns == CALENDAR_COLUMNS
    got = events(df)
    assert got == [
        (1, date(2024, 1, 1), date(1990, 1, 1), "Song C by Artist C reaches #1 on the c2"),
        (1, date(2024, 1, 1), date(1990, 1, 1), "Song D by Artist D reaches #1 on the c3"),
        (1, date(2024, 1, 6), date(1991, 1, 6), "Song B by Artist B reaches #1 on the c1"),
        (1, date(2024, 1, 7), date(1990, 1, 7), "Song A by Artist A reaches #1 on the c1"),
        (3, date(2024, 1, 15), date(1990, 1, 15), "Song E by Artist E reaches #1 on the c3"),
        (9, date(2024, 2, 29), date(1992, 2, 29), "Leap Song by Leap Artist reaches #1 on the c1"),
    ]


def test_calendar_2023_leap_adjustment_and_iso_edges(six):
    got = events(ones_calendar(six, year=2023))
    assert [(w, d) for w, d, _, _ in got] == [
        (1, date(2023, 1, 6)),
        (1, date(2023, 1, 7)),
        (2, date(2023, 1, 15)),
        (9, date(2023, 2, 28)),
        (52, date(2023, 1, 1)),
        (52, date(2023, 1, 1)),
    ]


def test_calendar_filters(six):
    got = events(ones_calendar(six, provider="p1", year=2024))
    assert got and all(e.endswith("c1") for *_, e in got)
    assert events(ones_calendar(six, chart="c2", year=2024))[0][3].endswith("c2")
    assert ones_calendar(six, today=date(2030, 5, 5)).collect()[0]["date"].year == 2030


def test_calendar_keeps_one_row_per_provider_for_shared_chart_names(spark):
    from toplist.operators.index import index_entries
    from toplist.schema import ENTRY_SCHEMA

    rows = [
        ("p1", "top", "weekly", date(1990, 3, 3), 1, "X", "Y"),
        ("p2", "top", "weekly", date(1991, 3, 2), 1, "X", "Y"),
        ("p2", "top", "weekly", date(1991, 3, 9), 1, "X", "Y"),
    ]
    idx = index_entries(spark.createDataFrame(rows, ENTRY_SCHEMA))
    got = events(ones_calendar(idx, year=2024))
    assert [(d, o) for _, d, o, _ in got] == [
        (date(2024, 3, 2), date(1991, 3, 2)),
        (date(2024, 3, 3), date(1990, 3, 3)),
    ]
    assert {e for *_, e in got} == {"Y by X reaches #1 on the top"}
