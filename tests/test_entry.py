"""Driver contract: entry, registered queries and oracles agree (sf0.001, DuckDB)."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark pages labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["provider", "chart", "artist", "song", "best_rank", "best_date"]
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple("∅" if pd.isna(v) else str(v)[:10] if hasattr(v, "isoformat") else str(v)
                        for v in row) for row in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _canon(got) == _canon(want)


#: The order each result is owed, as columns.
ORDERS = {
    "show_chart_date": ["provider", "chart", "this_week", "artist", "song"],
    "peak_year_default": ["provider", "chart", "artist", "best_rank", "song"],
    "anniversary_weekly": ["year", "provider", "chart", "date", "artist", "song"],
    "search_rows_artist": ["provider", "chart", "date", "this_week", "artist", "song"],
    "search_best_all": ["provider", "chart", "best_date", "best_rank", "artist", "song"],
    "calendar_common": ["week", "date", "original_date", "event"],
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_results_are_ordered(spark, name):
    rows = [tuple(r[c] for c in ORDERS[name]) for r in E.queries()[name](spark, SF).collect()]
    assert len(rows) > 1 and rows == sorted(rows)
