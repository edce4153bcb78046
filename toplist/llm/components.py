"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so a component of any size is
spread over the cluster; links never reach the driver.  The tables between
rounds are written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplist.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node it sees (itself included)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them (here ``b < a``)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node with a link; ``label`` is the smallest node of its component.

    ``links`` has long columns ``a`` and ``b``; order, repeats and self-links do not matter.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(ordered.distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        seen = mark
        now = stored(_small_star(_large_star(now).where("a <> b").distinct()).distinct(), "links")
