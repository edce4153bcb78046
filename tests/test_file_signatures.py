"""Character signatures: a necessary condition of two edits, and searches that read fewer files for the same rows."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from toplist.functions.fuzzy import dl_within_literal
from toplist.operators.file_signatures import (
    ALPHABET,
    build_file_signatures,
    character_mask,
    files_to_read,
    literal_mask,
    may_match,
    refresh_file_signatures,
    search_skipping,
)
from toplist.operators.index import build_index, read_index
from toplist.operators.lookup import search_hits
from toplist.schema import ENTRY_SCHEMA
from toplist.session import scratch_dir


def edited(rng, name, edits):
    for _ in range(edits):
        at = rng.randrange(len(name) + 1)
        kind = rng.randrange(4)
        c = rng.choice(ALPHABET)
        if kind == 0:
            name = name[:at] + c + name[at:]
        elif kind == 1:
            name = name[:at] + name[at + 1 :]
        elif kind == 2:
            name = name[:at] + c + name[at + 1 :]
        elif len(name) > 1:
            at = rng.randrange(len(name) - 1)
            name = name[:at] + name[at + 1] + name[at] + name[at + 2 :]
    return name


def test_mask_and_condition(spark):
    rng = random.Random(6)
    names = ["", "&", "a", ALPHABET, *["".join(rng.choice(ALPHABET[:12]) for _ in range(rng.randrange(1, 15))) for _ in range(200)]]
    names += [edited(rng, n, e) for n in names[:120] for e in (1, 2)]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string").select(
        "name", character_mask(F.col("name")).alias("artist_mask"), F.length("name").alias("artist_length")
    ).cache()
    assert all(r["artist_mask"] == literal_mask(r["name"]) for r in df.where("name is not null").collect())
    skipped = 0
    for q in names[:40]:
        counts = df.agg(
            F.count_if(dl_within_literal("name", q) & ~F.coalesce(may_match("artist", q), F.lit(False))),
            F.count_if(~F.coalesce(may_match("artist", q), F.lit(False))),
        ).first()
        assert counts[0] == 0
        skipped += counts[1]
    assert skipped > 40 * 100


YEARS = range(1990, 1996)
# Each year's artists use letters of their own.
LETTERS = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(1)
    rows = []
    for provider in ("p1", "p 2%/é"):
        for year, letters in zip(YEARS, LETTERS, strict=True):
            for k in range(30):
                artist = "".join(rng.choice(letters) for _ in range(9))
                rows.append((provider, "c", "weekly", date(year, 1, 6), k + 1, artist, rng.choice(["Song One", "Other Tune", None])))
    rows.append(("p1", "c", "weekly", date(1990, 1, 6), 31, None, "Only Song"))
    entries = spark.createDataFrame(rows, ENTRY_SCHEMA)
    path, signatures = scratch_dir(spark, "index"), scratch_dir(spark, "file-signatures")
    build_index(entries, path)
    build_file_signatures(spark, path, signatures)
    return entries, path, signatures


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fewer_files_and_the_same_rows(spark, stored):
    entries, path, signatures = stored
    index = read_index(spark, path)
    name = entries.where("year(date) = 1992").first()["artist"]
    for args in ({"artist": name}, {"artist": name[1:] + "l", "song": "song on"}, {"song": "only songs"}, {"artist": "0123456789"},
                 {"artist": name, "provider": "p1", "year": 1992}, {"artist": name, "best_position": True}, {}, {"artist": "(x)"}):
        assert rows(search_skipping(spark, path, signatures, **args)) == rows(search_hits(index, **args))
    files, every = files_to_read(spark, path, signatures, artist=name)
    assert every >= 12 and len(files) <= every // 3 and all("year=1992" in f for f in files)
    assert len(files_to_read(spark, path, signatures, artist="0123456789")[0]) == 0
    assert len(files_to_read(spark, path, signatures)[0]) == every
    scanned = search_skipping(spark, path, signatures, artist=name).inputFiles()
    assert len(scanned) == len(files)


def test_stale_signatures_lose_nothing(spark, stored):
    entries, _, _ = stored
    path, signatures = scratch_dir(spark, "index"), scratch_dir(spark, "file-signatures")
    build_index(entries, path)
    build_file_signatures(spark, path, signatures)
    changed = spark.createDataFrame([("p1", "c", "weekly", date(1995, 1, 6), 1, "abcdabcda", "New")], ENTRY_SCHEMA)
    build_index(changed, path, only_present_partitions=True)
    index = read_index(spark, path)
    want = rows(search_hits(index, artist="abcdabcda"))
    assert any(r[5] == "New" for r in want)
    assert rows(search_skipping(spark, path, signatures, artist="abcdabcda")) == want
    before = len(files_to_read(spark, path, signatures, artist="0123456789")[0])
    refresh_file_signatures(spark, path, signatures, [("p1", 1995)])
    assert before == 1 and files_to_read(spark, path, signatures, artist="0123456789")[0] == []
    assert rows(search_skipping(spark, path, signatures, artist="abcdabcda")) == want
