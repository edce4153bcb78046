"""Physical plan properties: pruning, push-down, codegen, no Python in queries."""

import re

import pytest
from conftest import SIX_ROWS

from toplist.operators.anniversary import anniversary_hits
from toplist.operators.calendar import ones_calendar
from toplist.operators.index import build_index, read_index
from toplist.operators.lookup import best_rank_in_year, search_hits, show_chart
from toplist.plans.inspect import plan_text
from toplist.schema import ENTRY_SCHEMA
from toplist.session import scratch_dir
from toplist.sources.feed import chart_feed


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_dir(spark, "plan-index")
    build_index(spark.createDataFrame(SIX_ROWS, ENTRY_SCHEMA), path)
    return read_index(spark, path)


def _node(plan: str, name: str) -> list[str]:
    blocks = [b.strip() for b in plan.split("\n\n")]
    return [b for b in blocks if re.match(rf"\(\d+\) {name}", b)]


def test_show_chart_prunes_partitions(stored):
    plan = plan_text(show_chart(stored, "1990-01-01", provider="p2"))
    (scan,) = _node(plan, "Scan parquet")
    assert "PartitionFilters" in scan
    assert "(year#" in scan.split("PartitionFilters")[1].split("\n")[0]
    assert "provider" in scan.split("PartitionFilters")[1].split("\n")[0]
    assert "EqualTo(date" in scan  # row-group pruning on date


def test_anniversary_prunes_years_and_pushes_rank(stored):
    plan = plan_text(anniversary_hits(stored, "2024-01-07", chart="c1"))
    (scan,) = _node(plan, "Scan parquet")
    assert "year" in scan.split("PartitionFilters")[1].split("\n")[0]
    assert "EqualTo(this_week,1)" in scan and "EqualTo(chart,c1)" in scan


def test_peak_prefilters_rank_and_keeps_year_test_above_aggregate(stored):
    plan = plan_text(best_rank_in_year(stored, 1990, 10))
    (scan,) = _node(plan, "Scan parquet")
    assert "LessThanOrEqual(this_week,10)" in scan
    # the year test cannot prune: every year can hold the all-time best
    assert "PartitionFilters" not in scan or "PartitionFilters: []" in scan
    filters = [b for b in _node(plan, "Filter") if "_best" in b]
    assert filters, "year predicate must sit above the aggregate"
    assert len(_node(plan, "HashAggregate")) == 2  # partial + final, one shuffle
    assert not _node(plan, "SortAggregate")


@pytest.mark.parametrize(
    "make",
    [
        lambda i: show_chart(i, "1990-01-01"),
        lambda i: anniversary_hits(i, "2024-01-07"),
        lambda i: best_rank_in_year(i, 1990),
        lambda i: ones_calendar(i, year=2024),
        lambda i: search_hits(i, artist="Leap Artst", song="leap song", year=1992),
        lambda i: search_hits(i, artist="Artist A", best_position=True),
    ],
)
def test_queries_run_without_python(stored, make):
    plan = plan_text(make(stored))
    assert "EvalPython" not in plan


def test_literal_fuzzy_filter_stays_in_codegen(spark, stored):
    # Without AQE the physical plan is final and marks codegen stages with "*(n)".
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_text(search_hits(stored, artist="Leap Artst"), "simple")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    fuzzy = [line for line in plan.splitlines() if "Filter" in line and "levenshtein" in line]
    assert fuzzy and all(re.search(r"\*\(\d+\) Filter", line) for line in fuzzy)


def test_feed_keeps_every_rank_and_runs_no_job_when_built(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("feed-plan", "")
    feed = chart_feed(spark, "/root/testdata/sf0.001")
    # Reading a table's schema is a job; nothing else runs before the query does.
    assert len(tracker.getJobIdsForGroup("feed-plan")) <= 5
    assert "WindowGroupLimit" not in plan_text(feed)


def test_fuzzy_join_checks_pairs_once_and_broadcasts_no_exploded_side(spark):
    from toplist.operators.fuzzy_join import fuzzy_name_join

    names = spark.createDataFrame([(f"name{i}",) for i in range(50)], "name string")
    plan = plan_text(fuzzy_name_join(names, names, "name", "name"))
    assert "BroadcastHashJoin" not in plan and len(_node(plan, "SortMergeJoin")) == 2
    for join in _node(plan, "SortMergeJoin"):
        assert "levenshtein" not in join
    checks = [b for b in _node(plan, "Filter") if "levenshtein" in b]
    assert len(checks) == 2 and all("shared" in b for b in checks)


def test_stored_searches_prune_and_push(spark):
    import __spark_entry__ as E

    plan = plan_text(E.queries()["search_song_in_year"](spark, "/root/testdata/sf0.001"))
    (scan,) = _node(plan, "Scan parquet")
    assert "year" in scan.split("PartitionFilters")[1].split("\n")[0]
    assert "artist_norm" not in scan.split("ReadSchema")[1]


def test_no_registered_query_pairs_rows_without_keys(spark):
    import __spark_entry__ as E

    for name, make in E.queries().items():
        if name == "pipeline" or name.startswith("op"):
            continue  # their plans run while they are built; tests/llm looks at them
        plan = plan_text(make(spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_anniversary_batch_is_an_equi_join(spark, stored):
    from datetime import date

    from toplist.operators.anniversary import anniversary_batch

    refs = spark.createDataFrame([(date(2024, 1, 7),), (date(2023, 12, 31),)], "ref_date date")
    plan = plan_text(anniversary_batch(stored, refs))
    (join,) = _node(plan, "(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)")
    assert "Left keys [3]" in join and "ref_year" in join


@pytest.mark.parametrize(
    "make",
    [
        lambda i: anniversary_hits(i, "2024-01-07"),
        lambda i: search_hits(i, artist="Leap Artst"),
    ],
)
def test_sorted_filter_scans_exchange_their_result_before_the_range_sort(stored, make):
    plan = plan_text(make(stored))
    exchanges = _node(plan, "Exchange")
    kinds = [("range" if "rangepartitioning" in b else "hash" if "hashpartitioning" in b else "?") for b in exchanges]
    assert kinds == ["hash", "range"], kinds
    assert len(_node(plan, "Scan parquet")) == 1
