"""Spelling variants: names linked by the fuzzy search share a canonical name, and peaks are taken over it.

Links are the pairs within two edits that :func:`fuzzy_name_join` finds among
the index's own normalised names; variants are the connected components of the
links.  Components are found by alternating large-star and small-star steps:
grouped minima and joins over links, no group or component is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplist.operators.fuzzy_join import fuzzy_name_join
from toplist.operators.lookup import best_rank
from toplist.session import written_once

#: Names shorter than this have no variants: two edits make most of another short name.
DEFAULT_MIN_LENGTH = 8


def linked_components(links: DataFrame) -> DataFrame:
    """``name, least`` for every name in ``links`` (``a, b``): the least name that links lead to, in string order."""
    now = written_once(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        # Large star: a name ties its greater neighbours to the least name it sees, itself included.
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        tied = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: it ties its lesser neighbours and itself to the least of them.
        least = tied.groupBy("a").agg(F.min("b").alias("m"))
        moved = tied.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written_once(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    heads = now.select(F.col("b").alias("name"), F.col("b").alias("least")).distinct()
    return now.select(F.col("a").alias("name"), F.col("b").alias("least")).union(heads)


def canonical_names(names: DataFrame, name_col: str = "name", min_length: int = DEFAULT_MIN_LENGTH) -> DataFrame:
    """``name, canonical``: each distinct non-null name and the least of its variants (itself, if it has none)."""
    every = names.select(F.col(name_col).alias("name")).where("name is not null").distinct()
    long = every.where(F.length("name") >= min_length)
    links = fuzzy_name_join(long.withColumnRenamed("name", "query"), long).where(F.col("query") < F.col("name"))
    found = linked_components(links.select(F.col("query").alias("a"), F.col("name").alias("b")))
    return every.join(found, "name", "left").select("name", F.coalesce("least", "name").alias("canonical"))


def best_rank_of_variants(
    index: DataFrame, fields: tuple[str, ...] = ("artist", "song"), min_length: int = DEFAULT_MIN_LENGTH
) -> DataFrame:
    """``provider, chart, artist, song, best_rank, best_date`` over canonical names.

    ``artist`` and ``song`` are normalised names, those of ``fields`` replaced
    by their canonical form, so that entries that differ in spelling only are
    one group; the best rank is taken as :func:`best_rank` does.  Null names
    are a group of their own.
    """
    rows = index.select("provider", "chart", "date", "this_week", "artist_norm", "song_norm")
    for field in fields:
        names = canonical_names(index.select(F.col(field + "_norm").alias("name")), min_length=min_length)
        names = written_once(names, "canonical")
        rows = rows.join(names.withColumnRenamed("name", field + "_norm"), field + "_norm", "left").withColumn(
            field + "_norm", F.col("canonical")
        ).drop("canonical")
    return best_rank(rows.withColumnsRenamed({"artist_norm": "artist", "song_norm": "song"}))
