"""First date at the best rank, with ties, null ranks and null dates (FIXTURES F4)."""

from datetime import date

from toplist.operators.lookup import best_rank


def test_best_rank_edge_rows(spark):
    rows = [
        ("a", 2, date(1990, 1, 1)),
        ("a", 1, date(1990, 2, 1)),
        ("a", 1, date(1990, 1, 15)),
        ("a", 1, None),
        ("b", None, date(1990, 1, 1)),
        ("b", 3, date(1991, 1, 1)),
        ("c", None, date(1990, 1, 1)),
        ("d", 1, None),
        ("d", 2, date(1980, 1, 1)),
    ]
    df = spark.createDataFrame(rows, "k string, this_week bigint, date date")
    got = {r["k"]: (r["best_rank"], r["best_date"]) for r in best_rank(df, ["k"]).collect()}
    assert got == {
        "a": (1, date(1990, 1, 15)),
        "b": (3, date(1991, 1, 1)),
        "c": (None, None),
        "d": (1, None),
    }
