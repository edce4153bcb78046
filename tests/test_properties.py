"""Hypothesis properties, batched so each example is one Spark job."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from test_fuzzy import dl

from toplist.functions.fuzzy import dl_within_literal
from toplist.functions.normalize import normalize_column, normalize_text
from toplist.operators.fuzzy_join import fuzzy_name_join

SMALL = st.text(alphabet="abc&1", max_size=7)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(q=SMALL, names=st.lists(SMALL, min_size=1, max_size=60))
def test_literal_predicate_is_textbook_dl(spark, q, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted(r["name"] for r in df.where(dl_within_literal("name", q)).collect())
    assert got == sorted(n for n in names if dl(n, q) <= 2)


@SETTINGS
@given(queries=st.lists(SMALL, min_size=1, max_size=15), names=st.lists(SMALL, min_size=1, max_size=30))
def test_fuzzy_join_is_brute_force(spark, queries, names):
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r["query"], r["name"]) for r in fuzzy_name_join(q, n, max_delete_len=4).collect()}
    assert got == {(a, b) for a in set(queries) for b in set(names) if dl(a, b) <= 2}


@SETTINGS
@given(values=st.lists(st.text(max_size=12), min_size=1, max_size=40))
def test_column_normalisation_equals_scalar(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "name string")
    for r in df.select("name", normalize_column("name").alias("n")).collect():
        assert r["n"] == normalize_text(r["name"]), repr(r["name"])
