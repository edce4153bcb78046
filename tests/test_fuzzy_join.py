"""Set-valued fuzzy search equals brute force (all pairs + textbook distance)."""

import random

from pyspark.sql import functions as F

from test_fuzzy import dl, mutations

from toplist.operators.fuzzy_join import fuzzy_name_join


def _check(spark, queries, names, **kw):
    qdf = spark.createDataFrame([(q,) for q in queries] + [(None,)], "query string")
    ndf = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {(r["query"], r["name"]) for r in fuzzy_name_join(qdf, ndf, **kw).collect()}
    want = {(q, n) for q in set(queries) for n in set(names) if dl(q, n) <= 2}
    assert got == want


def test_short_strings(spark):
    rng = random.Random(5)
    alphabet = "abcd"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 7))) for _ in range(60)]
    names = base + [m for b in base[:15] for m in mutations(b, rng, alphabet)[:5]]
    queries = base[:25] + [m for b in base[25:40] for m in mutations(b, rng, alphabet)[:3]]
    _check(spark, queries, names)


def test_long_strings_use_segments(spark):
    rng = random.Random(9)
    alphabet = "abcdefgh"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(8, 14))) for _ in range(25)]
    names = base + [m for b in base for m in mutations(b, rng, alphabet)[:6]]
    queries = base[:12] + [m for b in base[12:] for m in mutations(b, rng, alphabet)[:4]]
    # max_delete_len=9 routes most strings through the pigeonhole branch.
    _check(spark, queries, names, max_delete_len=9)


def test_duplicates_and_empty(spark):
    _check(spark, ["", "ab", "ab", "abc"], ["", "a", "xyz", "ab", "ba", "abcd"])


def test_search_batch_equals_one_search_per_query(spark, six):
    from toplist.operators.fuzzy_join import search_batch
    from toplist.operators.lookup import search_hits

    queries = ["Leap Artst", "Artist A", "(x)", "nobody at all"]
    qdf = spark.createDataFrame([(q,) for q in queries], "query string")
    got = sorted(tuple(r) for r in search_batch(six, qdf).collect())
    want = sorted((q, *tuple(r)) for q in queries for r in search_hits(six, artist=q).collect())
    assert got == want
    songs = sorted(tuple(r) for r in search_batch(six, qdf.select(F.lit("Leap Snog").alias("query")), by="song").collect())
    assert [r[-2] for r in songs] == ["Leap Artist"]


def test_search_batch_with_all_fields_equals_one_search_per_query(spark, six):
    from datetime import date

    from toplist.operators.fuzzy_join import search_batch
    from toplist.operators.lookup import search_hits

    queries = [
        ("q1", "Artst A", "Song A", None, None, None, None),
        ("q2", "Artist A", "Song", None, "c1", None, None),
        ("q3", "Artist", None, "p1", "", None, 1991),
        ("q4", None, "Song C", None, None, date(1990, 1, 1), None),
        ("q5", "", "Snog D", "p9", None, None, None),
        ("q6", None, None, "p1", None, None, None),
        ("q1", "Artst A", "Song A", None, None, None, None),
        (None, "Artist A", None, None, None, None, None),
    ]
    schema = "query string, artist string, song string, provider string, chart string, date date, year int"
    got = sorted(tuple(r) for r in search_batch(six, spark.createDataFrame(queries, schema)).collect())
    want = set()
    for q, artist, song, provider, chart, day, year in queries[:5]:
        hits = search_hits(six, artist, song, day and day.isoformat(), year, provider=provider, chart=chart)
        want |= {(q, *tuple(r)) for r in hits.collect()}
    assert got == sorted(want) and len(got) >= 4


def test_search_batch_meets_an_artists_rows_with_the_songs_asked_for_only(spark):
    from datetime import date

    from toplist.operators.fuzzy_join import search_batch
    from toplist.operators.index import index_entries
    from toplist.plans.inspect import plan_text
    from toplist.schema import ENTRY_SCHEMA

    song = lambda i: chr(97 + i % 26) * 6 + str(i // 26) * 6
    rows = [("p", "c", "weekly", date(1990, 1, 7), i, "Same Artist", song(i)) for i in range(40)]
    idx = index_entries(spark.createDataFrame(rows, ENTRY_SCHEMA)).cache()
    queries = [(f"q{i}", "Same Artst", song(i) + "x", "p" if i % 2 else None) for i in range(40)]
    found = search_batch(idx, spark.createDataFrame(queries, "query string, artist string, song string, provider string"))
    got = sorted((r["query"], r["song"]) for r in found.collect())
    # Without the songs in the join each query would meet all 40 rows first.
    assert got == sorted((f"q{i}", song(i)) for i in range(40))
    plan = plan_text(found)
    assert "LeftSemi" not in plan and any(
        "artist_norm" in line and "song_norm" in line for line in plan.splitlines() if line.startswith("Left keys [2]")
    )
