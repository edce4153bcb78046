"""Maintained peaks equal the full aggregate after random series of edits."""

from __future__ import annotations

import random
from datetime import date, timedelta
from pathlib import Path

import pytest

from toplist.operators.index import index_entries
from toplist.operators.lookup import best_rank, best_rank_in_year
from toplist.operators.peaks import build_peaks, peaks_in_year, read_peaks, update_peaks
from toplist.schema import ENTRY_SCHEMA
from toplist.session import scratch_dir

PROVIDERS, YEARS = ["p1", "p 2/%", "p3"], [1990, 1991, 1992, None]


def some_rows(rng, provider, year):
    out = []
    for _ in range(rng.randrange(0, 14)):
        day = None if year is None else date(year, 1, 1) + timedelta(days=rng.randrange(300))
        name = rng.choice(["A", "B", "C", None, ""])
        out.append((provider, rng.choice(["c1", "c2"]), "weekly", day, rng.choice([1, 2, 3, 9, None]), name, rng.choice(["s", "t", None])))
    return out


def index_of(spark, partitions):
    rows = [r for part in partitions.values() for r in part]
    return index_entries(spark.createDataFrame(rows, ENTRY_SCHEMA))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits(spark, seed):
    rng = random.Random(seed)
    state = {(p, y): some_rows(rng, p, y) for p in PROVIDERS for y in YEARS}
    path = scratch_dir(spark, "peaks")
    build_peaks(index_of(spark, state), path, slices=3)
    assert rows(read_peaks(spark, path)) == rows(best_rank(index_of(spark, state)))
    for _ in range(4):
        edited = rng.sample(sorted(state, key=repr), rng.choice([1, 2, 5]))
        for key in edited:
            kind = rng.random()
            if kind < 0.25:
                state[key] = []
            elif kind < 0.6:
                state[key] = [r for r in state[key] if rng.random() < 0.5]
            else:
                state[key] = state[key] + some_rows(rng, *key)
        full = index_of(spark, state)
        # Rows of other partitions may be there; they are not looked at.
        update_peaks(spark, path, full, edited)
        assert rows(read_peaks(spark, path)) == rows(best_rank(full))
    assert rows(peaks_in_year(spark, path, 1991, 2)) == rows(best_rank_in_year(full, 1991, 2))


def test_update_again_and_untouched_slices(spark):
    rng = random.Random(5)
    state = {(p, y): some_rows(rng, p, y) for p in PROVIDERS for y in YEARS}
    path = scratch_dir(spark, "peaks")
    build_peaks(index_of(spark, state), path, slices=4)
    before = {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    state[("p1", 1990)] = [("p1", "c1", "weekly", date(1990, 1, 1), 1, "New", "Song")]
    full = index_of(spark, state)
    for _ in range(2):  # the second time changes nothing
        update_peaks(spark, path, full, [("p1", 1990)])
        assert rows(read_peaks(spark, path)) == rows(best_rank(full))
    after = {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    others = [f for f in before if "provider=p1" not in f and "/spec/" not in f]
    assert others and all(after[f] == before[f] for f in others)
    update_peaks(spark, path, full, [])
    assert rows(read_peaks(spark, path)) == rows(best_rank(full))
