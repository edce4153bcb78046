"""The search index: normalised chart entries, partitioned by provider and year.

``index_entries`` turns chart entries into index rows (normalised names plus
date parts); ``write_index`` persists them as Parquet partitioned by
``provider``/``year`` and sorted by ``chart, date`` inside each file, so that
provider and year filters prune directories and chart/date filters prune row
groups; ``read_index`` reads it back with the declared schema (partition type
inference would turn a numeric provider name into a number).
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toplist.functions.normalize import normalize_column
from toplist.schema import INDEX_COLUMNS, INDEX_PARTITION_COLUMNS, INDEX_SCHEMA


def index_entries(entries: DataFrame) -> DataFrame:
    """Chart entries -> index rows (``artist_norm``, ``song_norm``, ``year``, ``month``, ``day``).

    ``entries`` needs ``provider, chart, frequency, date, this_week, artist, song``
    with ``date`` a date and ``this_week`` a bigint (sources cast strictly).
    Columns a query does not use are pruned by the optimizer, so the
    normalisation only runs when a query reads the normalised names.
    """
    return entries.select(
        "provider",
        "chart",
        "frequency",
        "date",
        F.col("this_week").cast("bigint").alias("this_week"),
        "artist",
        "song",
        normalize_column("artist").alias("artist_norm"),
        normalize_column("song").alias("song_norm"),
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
    )


log = logging.getLogger(__name__)

# Order inside the written files: directory columns first, then the columns
# queries filter on, then the names.
_CLUSTER_COLUMNS = [*INDEX_PARTITION_COLUMNS, "chart", "date", "this_week", "artist", "song"]


def build_index(
    entries: DataFrame, path: str, mode: str = "overwrite", only_present_partitions: bool = False
) -> None:
    """Normalise chart entries and write them as the index (see :func:`write_index`).

    The rows are dealt by (provider, year) before the normalisation, from their
    real sizes: AQE splits a large directory over several tasks and joins small
    ones, and nothing upstream runs twice.
    """
    dealt = entries.withColumn("_year", F.year("date")).hint("rebalance", "provider", "_year").drop("_year")
    _write(index_entries(dealt), path, mode, only_present_partitions)


def write_index(
    index: DataFrame, path: str, mode: str = "overwrite", only_present_partitions: bool = False
) -> None:
    """Write index rows as Parquet partitioned by provider and year.

    Rows are dealt by (provider, year), large directories split by AQE from
    their real sizes.  Inside a file rows are ordered by chart and date for
    row-group pruning.  ``mode="overwrite"`` replaces the whole index (a full
    rebuild); with ``only_present_partitions`` it replaces only the
    (provider, year) directories present in ``index`` and keeps the others.
    """
    dealt = index.select(*INDEX_COLUMNS).hint("rebalance", *INDEX_PARTITION_COLUMNS)
    _write(dealt, path, mode, only_present_partitions)


def _write(index: DataFrame, path: str, mode: str, only_present_partitions: bool) -> None:
    (
        index.select(*INDEX_COLUMNS)
        .sortWithinPartitions(*_CLUSTER_COLUMNS)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic" if only_present_partitions else "static")
        .partitionBy(*INDEX_PARTITION_COLUMNS)
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame:
    """Lazy scan of an index written by :func:`write_index`, in index column order.

    A missing index logs a warning and gives an empty index with the full
    schema (so every query still returns its own typed, empty result).
    """
    try:
        return spark.read.schema(INDEX_SCHEMA).parquet(path).select(*INDEX_COLUMNS)
    except AnalysisException as exc:
        if not missing_ok or "PATH_NOT_FOUND" not in str(exc):
            raise
        log.warning("Index not found at %s; build it first.", path)
        return spark.createDataFrame([], INDEX_SCHEMA)


def build_search_index(
    spark: SparkSession, data_root: str, path: str, descriptors: str | None = None, multi_line: bool = True
) -> None:
    """Build the index of a provider tree.

    The charts and their files come from the catalog and package descriptors
    (``descriptors`` names their folder, else the tree's own) where the tree
    has them, and from the providers' metadata otherwise.  ``multi_line=False``
    lets Spark split very large files whose fields hold no line breaks.
    """
    from toplist.sources.csv_tree import read_tree_entries

    build_index(read_tree_entries(spark, data_root, descriptors, multi_line), path)
