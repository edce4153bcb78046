"""Global ordering of a filtered scan without scanning twice.

A global ``orderBy`` range-partitions its input, and the range partitioner
first runs a sampling job over that input.  When the input is a filter over
an index scan, the sampling job re-runs the whole scan and filter (the event
log shows every index row read twice).  Exchanging the filtered rows first --
hash-partitioned on all output columns, so no value can concentrate them --
makes the sampler read that exchange's output instead: the index is scanned
and the filter evaluated once, at the cost of one extra shuffle of the
(usually small) result.  Sorts that already sit on an aggregate's exchange
do not need this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def sorted_result(df: DataFrame, *keys: str) -> DataFrame:
    """``df.orderBy(*keys)``, with the rows exchanged once before the range sort."""
    return df.repartition(*df.columns).orderBy(*keys)
