from __future__ import annotations

import json
import os
import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from toplist.operators.index import index_entries  # noqa: E402
from toplist.schema import ENTRY_SCHEMA  # noqa: E402
from toplist.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(os.environ.get("TEST_CPUS", "*"), shuffle_partitions=8, app="toplist-tests")
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


# The six-row index fixture: weekly p1/c1, monthly p2/c2, fortnightly p3/c3, a Feb 29.
SIX_ROWS = [
    ("p1", "c1", "weekly", date(1990, 1, 7), 1, "Artist A", "Song A"),
    ("p1", "c1", "weekly", date(1991, 1, 6), 1, "Artist B", "Song B"),
    ("p2", "c2", "monthly", date(1990, 1, 1), 1, "Artist C", "Song C"),
    ("p3", "c3", "fortnightly", date(1990, 1, 1), 1, "Artist D", "Song D"),
    ("p3", "c3", "fortnightly", date(1990, 1, 15), 1, "Artist E", "Song E"),
    ("p1", "c1", "weekly", date(1992, 2, 29), 1, "Leap Artist", "Leap Song"),
]


@pytest.fixture(scope="session")
def six(spark):
    entries = spark.createDataFrame(SIX_ROWS, ENTRY_SCHEMA)
    return index_entries(entries).cache()


def artists(df) -> list[str]:
    return sorted(r["artist"] for r in df.select("artist").collect())


def events(df) -> list:
    return [(r["week"], r["date"], r["original_date"], r["event"]) for r in df.collect()]


def write_tree(root: Path) -> Path:
    """A provider tree with metadata and annual CSV files (edge cases included)."""
    (root / "radio").mkdir(parents=True)
    (root / "radio" / "radio-metadata.json").write_text(
        json.dumps(
            {
                "name": "Radio Uno",
                "country": "Spain",
                "folder": "radio",
                "url": "",
                "prefix": "radio-uno",
                "charts": [
                    {
                        "name": "Radio Top 40",
                        "folder": "top40",
                        "prefix": "radio-top40",
                        "size": 3,
                        "frequency": "weekly",
                        "day_of_week": "Saturday",
                        "start_date": "1989-01-07",
                        "fields": ["date", "this_week", "artist", "song", "last_week"],
                    },
                    {
                        "name": "Radio Latin",
                        "folder": "latin",
                        "prefix": "radio-latin",
                        "size": 2,
                        "frequency": "monthly",
                        "day_of_week": "Monday",
                        "start_date": "1990-01-01",
                        "end_date": "1990-12-01",
                        "size_history": [{"start": "1990-01-01", "end": "1990-06-01", "size": 2}],
                        "fields": ["song", "artist", "this_week", "date", "composer", "weeks_on_chart"],
                    },
                    {
                        "name": "Radio Empty",
                        "folder": "empty",
                        "prefix": "radio-empty",
                        "size": 10,
                        "frequency": "fortnightly",
                        "start_date": "1995-01-01",
                        "fields": ["date", "this_week", "artist", "song"],
                    },
                ],
            },
            ensure_ascii=False,
        ),
        encoding="utf-8",
    )
    top = root / "radio" / "top40"
    top.mkdir()
    (top / "1989.csv").write_text(
        "date,this_week,artist,song,last_week\n"
        '1989-12-30,1,"The Beatles","Hey ""Jude""",2\n'
        '1989-12-30,2,"Lady Gaga feat. Colby O\'Donis","Just\nDance",\n'
        "1989-12-30,3,,Nameless,1\n",
        encoding="utf-8",
    )
    (top / "1990.csv").write_text(
        "date,this_week,artist,song,last_week\n"
        "1990-01-06,1,Édith Piaf,La Vie en Rose (Live),\n"
        "1990-01-06,2,The Beatles,\"Hey \"\"Jude\"\"\",1\n",
        encoding="utf-8",
    )
    latin = root / "radio" / "latin"
    latin.mkdir()
    (latin / "1990.csv").write_text(
        "song,artist,this_week,date,composer,weeks_on_chart\n"
        "Bamboleo,Gipsy Kings,1,1990-01-01,Someone,4\n"
        "Tu Amor,Los Lobos y Amigos,2,1990-01-01,,1\n",
        encoding="utf-8",
    )
    (root / "radio" / "empty").mkdir()
    # A directory without metadata must be skipped.
    (root / "notes").mkdir()
    (root / "notes" / "readme.txt").write_text("not a provider", encoding="utf-8")
    return root
