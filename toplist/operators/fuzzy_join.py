"""Set-valued fuzzy search: every (query, name) pair within 2 Damerau-Levenshtein edits.

The literal search tests one query against every row.  For a *table* of
queries that becomes a similarity join, done here without any cross
product, as hash equi-joins on signatures followed by exact verification:

* Short strings (length <= ``max_delete_len``): the deletion neighbourhood
  (the string with 0, 1 or 2 characters deleted; the symmetric-delete /
  FastSS idea).  Each edit of a DL script -- substitution, insertion,
  deletion, or a transposition of which one character is deleted on both
  sides -- is absorbed by at most one deletion per side, so two strings
  within 2 edits always share a neighbourhood key.
* Long strings: pigeonhole segments (the Pass-Join idea).  The query is cut
  into 5 segments; two edits touch at most 4 of them (a transposition may
  straddle a boundary), so one segment survives intact in the name, shifted
  by at most 2 positions.  A name emits, for each query length within 2 of
  its own, each segment slot and each shift, its substring there -- 125
  keys whatever its length -- and the query emits its 5 segments.

Both sides are reduced to distinct strings first and keys are hashed to
64 bits (a collision only adds a candidate).  The exploded key tables are many
times larger than the planner can tell from their inputs, so they meet in a
merge join.  Candidate pairs are de-duplicated by an aggregate and only then
checked with the exact column predicate, once per pair.  The routing finds each
true pair in exactly one branch: pairs of two short strings in the
neighbourhood branch, pairs with a string longer than ``max_delete_len`` (hence
both at least ``max_delete_len - 1`` long) in the segment branch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toplist.functions.fuzzy import dl_within2_columns
from toplist.functions.normalize import normalize_column
from toplist.schema import SEARCH_ROW_COLUMNS

# Edits allowed (the search threshold) and the pigeonhole segment count.
MAX_EDITS = 2
SEGMENTS = 2 * MAX_EDITS + 1
# Up to this length a string has fewer deletion keys than segment keys (at most 106 against 125 + 5).
DEFAULT_MAX_DELETE_LEN = 14


def _int_range(lo: Column, hi: Column) -> Column:
    """``[lo..hi]`` or an empty array when ``hi < lo`` (``sequence`` would count down)."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _delete1(s: Column, i: Column) -> Column:
    return F.concat(F.substring(s, F.lit(1), i - 1), F.substr(s, i + 1))


def _delete2(s: Column, i: Column, j: Column) -> Column:
    return F.concat(
        F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, j - i - 1), F.substr(s, j + 1)
    )


def deletion_keys(s: Column) -> Column:
    """Distinct strings obtained from ``s`` by deleting 0, 1 or 2 characters."""
    n = F.length(s)
    idx = _int_range(F.lit(1), n)
    one = F.transform(idx, lambda i: _delete1(s, i))
    two = F.flatten(
        F.transform(
            idx,
            lambda i: F.transform(_int_range(i + 1, n), lambda j: _delete2(s, i, j)),
        )
    )
    return F.array_distinct(F.concat(F.array(s), one, two))


def _seg_len(m: Column, j: Column) -> Column:
    base = F.floor(m / SEGMENTS).cast("int")
    return base + F.when(j < F.pmod(m, F.lit(SEGMENTS)), 1).otherwise(0)


def _seg_start(m: Column, j: Column) -> Column:
    base = F.floor(m / SEGMENTS).cast("int")
    return F.lit(1) + j * base + F.least(j, F.pmod(m, F.lit(SEGMENTS)))


def _segment_key(m: Column, j: Column, piece: Column) -> Column:
    return F.xxhash64(m, j, piece)


def query_segment_keys(q: Column) -> Column:
    m = F.length(q)
    return F.transform(
        F.sequence(F.lit(0), F.lit(SEGMENTS - 1)),
        lambda j: _segment_key(m, j, F.substring(q, _seg_start(m, j), _seg_len(m, j))),
    )


def name_segment_keys(a: Column, min_query_len: int) -> Column:
    """Keys of ``a`` for every query length within 2, segment slot and shift."""
    n = F.length(a)
    lengths = F.filter(
        F.sequence(n - MAX_EDITS, n + MAX_EDITS), lambda m: m >= F.lit(min_query_len)
    )
    shifts = F.sequence(F.lit(-MAX_EDITS), F.lit(MAX_EDITS))
    slots = F.sequence(F.lit(0), F.lit(SEGMENTS - 1))

    def per_slot(m, j):
        start, length = _seg_start(m, j), _seg_len(m, j)
        valid = F.filter(shifts, lambda d: (start + d >= 1) & (start + d + length - 1 <= n))
        return F.transform(
            valid, lambda d: _segment_key(m, j, F.substring(a, start + d, length))
        )

    return F.flatten(
        F.transform(lengths, lambda m: F.flatten(F.transform(slots, lambda j: per_slot(m, j))))
    )


def _candidates(q: DataFrame, n: DataFrame, q_keys: Column, n_keys: Column) -> DataFrame:
    qk = q.select("query", F.explode(q_keys).alias("key"))
    nk = n.select("name", F.explode(n_keys).alias("key"))
    met = qk.hint("merge").join(nk.hint("merge"), "key")
    return met.groupBy("query", "name").agg(F.count("*").alias("shared"))


def fuzzy_name_join(
    queries: DataFrame,
    names: DataFrame,
    query_col: str = "query",
    name_col: str = "name",
    max_delete_len: int = DEFAULT_MAX_DELETE_LEN,
) -> DataFrame:
    """Distinct ``(query, name)`` pairs with ``damerau_levenshtein(query, name) <= 2``.

    Both inputs are compared as given (pass normalised strings); nulls never match.
    """
    q = queries.select(F.col(query_col).alias("query")).where(F.col("query").isNotNull()).distinct()
    n = names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).distinct()

    short_q = q.where(F.length("query") <= max_delete_len)
    short_n = n.where(F.length("name") <= max_delete_len)
    by_deletion = _candidates(
        short_q,
        short_n,
        F.transform(deletion_keys(F.col("query")), lambda k: F.xxhash64(k)),
        F.transform(deletion_keys(F.col("name")), lambda k: F.xxhash64(k)),
    )

    min_long = max_delete_len - MAX_EDITS + 1
    long_q = q.where(F.length("query") >= min_long)
    long_n = n.where(F.length("name") >= min_long)
    by_segment = _candidates(
        long_q,
        long_n,
        query_segment_keys(F.col("query")),
        name_segment_keys(F.col("name"), min_long),
    )

    by_segment = by_segment.where(F.greatest(F.length("query"), F.length("name")) > max_delete_len)
    # The check depends on the aggregate's own column, so it cannot move below the de-duplication.
    close = F.when(F.col("shared") > 0, dl_within2_columns(F.col("query"), F.col("name"))).otherwise(F.lit(False))
    return by_deletion.unionByName(by_segment).where(close).select("query", "name")


#: Columns a query table may have besides its key; null or empty means "any".
QUERY_FIELDS = ["artist", "song", "provider", "chart", "date", "year"]


def search_batch(
    index: DataFrame,
    queries: DataFrame,
    query_col: str = "query",
    by: str = "artist",
    name_join: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Row-mode search for a whole table of queries at once.

    ``queries`` has a key ``query_col`` and any of :data:`QUERY_FIELDS`; a table
    without a name column is read as one misspelt ``by`` name per row, the key
    itself.  Each raw name is normalised like the index names and matched to the
    *distinct* normalised names of the index by :func:`fuzzy_name_join`; the
    matches meet the index rows in equi-joins on the normalised names, on both
    at once for queries with both (AQE splits a hot name), and provider, chart,
    date and year are residual conditions.  Queries that repeat count once; a query with neither artist nor
    song, like one with a null key, matches nothing.  ``name_join(queries,
    field)`` finds the ``(query, name)`` pairs another way, for instance in a
    stored signature index.
    Output, in no order: ``query`` plus the search row columns.
    """
    fields = [c for c in QUERY_FIELDS if c in queries.columns and c != query_col]
    given = {c: F.col(c) for c in fields}
    if "artist" not in given and "song" not in given:
        given[by] = F.col(query_col)
    types = {"date": "date", "year": "int"}
    q = queries.where(F.col(query_col).isNotNull()).select(
        F.col(query_col).alias("query"),
        *[
            (F.nullif(given[c], F.lit("")) if c in given and c not in types else given.get(c, F.lit(None)))
            .cast(types.get(c, "string"))
            .alias("q_" + c)
            for c in QUERY_FIELDS
        ],
    ).distinct()

    def pairs(name: str) -> DataFrame:
        """Names asked for in this field, normalised, and the index names they match."""
        asked = q.where(F.col("q_" + name).isNotNull()).select(normalize_column("q_" + name).alias("query"))
        if name_join is not None:
            found = name_join(asked, name)
        else:
            found = fuzzy_name_join(asked, index.select(F.col(name + "_norm").alias("name")))
        return found.select(F.col("query").alias("_" + name), F.col("name").alias(name + "_norm"))

    filters = [F.col("q_" + c).isNull() | (F.col("q_" + c) == F.col(c)) for c in ("provider", "chart", "date", "year")]
    every = reduce(lambda x, y: x & y, filters)
    names = [c for c in ("artist", "song") if c in given]
    matched = {c: pairs(c) for c in names}
    found = []
    for wanted in [names, *([c] for c in names if len(names) > 1)]:
        # Queries with just these names, once per combination of index names they match.  Names are
        # combined before the index rows come in: an artist's rows are only met with the songs asked for.
        asked = q.where(reduce(lambda x, y: x & y, [F.col("q_" + c).isNotNull() if c in wanted else F.col("q_" + c).isNull() for c in names]))
        for c in wanted:
            asked = asked.withColumn("_" + c, normalize_column("q_" + c)).join(matched[c], "_" + c)
        rows = index.join(asked, [c + "_norm" for c in wanted]).where(every)
        found.append(rows.select("query", *SEARCH_ROW_COLUMNS))
    return reduce(DataFrame.unionByName, found)
