"""The stored signature index: equal to the join on all names, no exchange of the names, rebuilt by partition."""

from __future__ import annotations

import random
import re

import pytest

from toplist.functions.normalize import normalize_text
from toplist.operators.fuzzy_join import fuzzy_name_join, search_batch
from toplist.operators.index import index_entries
from toplist.operators.signatures import (
    build_signatures,
    open_signatures,
    refresh_signatures,
    signature_name_join,
)
from toplist.plans.inspect import plan_text
from toplist.schema import ENTRY_SCHEMA
from toplist.session import scratch_dir
from datetime import date


def names(rng, n):
    out = ["", "a", "ab", "ba", "abc", "x" * 14, "x" * 15, "x" * 13 + "y"]
    while len(out) < n:
        base = rng.choice(out) if rng.random() < 0.5 else ""
        size = rng.choice([1, 2, 3, 6, 11, 13, 14, 15, 16, 20, 40])
        word = (base + "".join(rng.choice("abc") for _ in range(size)))[: max(1, size)]
        at = rng.randrange(len(word))
        out.append(word[:at] + rng.choice(["", "a", "bc"]) + word[at + 1 :])
    return out


def index_of(spark, rng, partitions):
    rows = []
    for provider, year in partitions:
        for name in names(rng, 40):
            rows.append((provider, "c", "weekly", date(year, 3, 4), 1, name, name[::-1]))
    rows.append(("p1", "c", "weekly", date(1990, 3, 4), 2, None, "only a song"))
    return index_entries(spark.createDataFrame(rows, ENTRY_SCHEMA)).cache()


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark):
    index = index_of(spark, random.Random(1), [("p1", 1990), ("p1", 1991), ("p 2/x", 1990)])
    return index, build_signatures(index, scratch_dir(spark, "signatures"), buckets=4)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(2)
    rows = [(q,) for q in [*names(random.Random(1), 20), *names(rng, 30), None, "onlyasong"]]
    return spark.createDataFrame(rows, "query string").cache()


def test_equal_to_the_join_on_all_names(built, asked):
    index, stored = built
    for field in ("artist", "song"):
        every = fuzzy_name_join(asked, index, "query", field + "_norm")
        got = pairs(signature_name_join(stored, asked, field))
        assert got == pairs(every) and len(got) > 50


def test_names_are_not_exchanged(built, asked):
    plan = plan_text(signature_name_join(built[1], asked, "artist"))
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert len(re.findall(r"Arguments: hashpartitioning\(key#\d+L?, 4\)", plan)) == 1
    assert "PartitionFilters: [isnotnull(field" in plan


def test_search_batch_with_stored_names(spark, built):
    index, stored = built
    queries = spark.createDataFrame(
        [("q1", "abc", None, None), ("q2", "abca", "a", "p1"), ("q3", None, "cba", None), ("q4", None, None, "p1")],
        "query string, artist string, song string, provider string",
    )
    through = lambda q, field: signature_name_join(stored, q, field)
    got = pairs(search_batch(index, queries, name_join=through))
    assert got == pairs(search_batch(index, queries)) and got


def test_refresh_of_partitions(spark, asked):
    rng = random.Random(3)
    old = index_of(spark, rng, [("p1", 1990), ("p1", 1991), ("p2", 1990), ("it's", 1990)])
    stored = build_signatures(old, scratch_dir(spark, "signatures"), buckets=4)
    other = index_of(spark, random.Random(9), [("p1", 1991), ("p3", 1999)]).where("year <> 1990")
    kept = old.where("not (provider = 'p1' and year = 1991) and provider <> \"it's\"")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    refresh_signatures(stored, other, removed=[("it's", 1990)])
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    now = kept.unionByName(other)
    for field in ("artist", "song"):
        assert pairs(signature_name_join(stored, asked, field)) == pairs(fuzzy_name_join(asked, now, "query", field + "_norm"))
    shown = {r[0] for r in spark.sql(f"show partitions {stored.table}").collect()}
    assert "field=artist/provider=p3/year=1999" in shown and not any("it" in x.split("provider=")[1] for x in shown)


def test_opened_in_another_session(spark, built, asked):
    index, stored = built
    again = open_signatures(spark, stored.path, buckets=stored.buckets)
    assert again.table != stored.table
    plan = plan_text(signature_name_join(again, asked, "song"))
    assert len(re.findall(r"Arguments: hashpartitioning\(key#\d+L?, 4\)", plan)) == 1
    assert pairs(signature_name_join(again, asked, "song")) == pairs(signature_name_join(stored, asked, "song"))


def test_empty_index_and_unknown_field(spark, asked):
    index = index_of(spark, random.Random(1), [("p1", 1990)]).where("false")
    stored = build_signatures(index, scratch_dir(spark, "signatures"), buckets=2)
    assert signature_name_join(stored, asked, "artist").count() == 0
    with pytest.raises(ValueError, match="no signatures"):
        signature_name_join(stored, asked, "title")


def test_normalised_queries_find_normalised_names(spark, built):
    queries = spark.createDataFrame([(normalize_text("Only, a Song!"),)], "query string")
    assert ("onlyasong", "onlyasong") in pairs(signature_name_join(built[1], queries, "song"))
