"""Annual chart CSV files -> typed chart entries.

Layout: ``<root>/<provider dir>/<chart folder>/YYYY.csv`` with a header row.
Which files belong to which chart, and the column layout, come from the package
descriptors (their ``path`` and ``schema``) or from the providers' metadata
(every CSV file directly in the chart's folder, the ``fields`` list).

Spark maps a CSV schema onto columns by *position*, so files are read in
groups of identical layout -- one multi-path scan per distinct field list
(usually one for the whole tree) -- with ``enforceSchema=false``, which
checks every file's header against the layout and fails the read on a
mismatch instead of silently swapping columns.  Columns arrive as strings;
``date`` is parsed strictly as ``yyyy-MM-dd`` and ``this_week`` cast strictly
to bigint (ANSI mode: a malformed value fails the build; empty stays null).
The provider/chart/frequency tags come from a join of each row's file to the
list of files.
"""

from __future__ import annotations

import logging
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toplist.sources.catalog import (
    below_root,
    chart_catalog,
    charts_with_files,
    clean_path,
    find_catalog,
    read_described_charts,
    read_metadata,
    root_path,
    source_path,
)

REQUIRED = ["date", "this_week", "artist", "song"]

log = logging.getLogger(__name__)


def literal_glob(path: str) -> str:
    """A path that Hadoop's globbing reads as it stands."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _read_layout(
    spark: SparkSession, root: str, files: list[str], fields: list[str], multi_line: bool
) -> DataFrame:
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv([f"{root}/{literal_glob(f)}" for f in files])
        .select(*REQUIRED, below_root(source_path(), root_path(spark, root)).alias("_file"))
    )


def chart_files(charts: DataFrame) -> DataFrame:
    """One row per file of ``charts`` (``provider, chart, frequency, fields, paths``): ``path``, and ``_file`` below the root."""
    return charts.select(
        "provider", "chart", "frequency", "fields", F.explode_outer("paths").alias("path")
    ).withColumn("_file", clean_path(F.concat_ws("/", "provider", "path")))


def read_files(spark: SparkSession, root: str, files: DataFrame, multi_line: bool = True) -> DataFrame:
    """Entries of ``files`` (rows of :func:`chart_files`), with the ``_file`` each comes from."""
    root = root.rstrip("/")
    # The list of files is catalog metadata: one entry per chart and year.
    layouts: dict[tuple[str, ...], set[str]] = {}
    for row in files.collect():
        if row["path"] is None:
            log.warning("Chart %s of %s has no file.", row["chart"], row["provider"])
            continue
        fields = tuple(row["fields"] or REQUIRED)
        missing = [c for c in REQUIRED if c not in fields]
        if missing:
            raise ValueError(f"chart {row['provider']}/{row['chart']} lacks columns {missing}")
        layouts.setdefault(fields, set()).add(row["_file"])
    if not layouts:
        raise ValueError("No data found to index.")
    rows = reduce(
        DataFrame.unionByName,
        [_read_layout(spark, root, sorted(fs), list(fields), multi_line) for fields, fs in sorted(layouts.items())],
    )
    tags = files.where("path is not null").select("_file", "provider", "chart", "frequency").distinct()
    return rows.join(tags, "_file").select(
        "_file",
        "provider",
        "chart",
        "frequency",
        F.to_date("date", "yyyy-MM-dd").alias("date"),
        F.col("this_week").cast("bigint").alias("this_week"),
        "artist",
        "song",
    )


def listed_charts(spark: SparkSession, root: str) -> DataFrame:
    """Charts of the providers' metadata with the CSV files in their folders: ``provider, chart, frequency, fields, paths``."""
    return charts_with_files(spark, root, chart_catalog(read_metadata(spark, root))).select(
        "provider",
        F.col("chart.prefix").alias("name"),
        F.col("chart.frequency").alias("frequency"),
        F.col("chart.fields").alias("fields"),
        "paths",
    ).withColumnRenamed("name", "chart")


def tree_charts(spark: SparkSession, root: str, descriptors: str | None = None) -> DataFrame:
    """Charts and files by the descriptors where the tree has a catalog, by its metadata otherwise."""
    if find_catalog(spark, root, descriptors) is not None:
        return read_described_charts(spark, root, descriptors)
    return listed_charts(spark, root)


def read_chart_entries(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """All chart rows under ``root`` as ``provider, chart, frequency, date, this_week, artist, song``.

    Charts and their folders (nested or not) come from the providers' metadata;
    a chart without files is logged.  ``multi_line`` keeps quoted fields with
    embedded newlines intact (RFC 4180) at the price of one task per file;
    annual chart files are small, so that is the default.  Pass ``False`` for
    very large files without embedded newlines to let Spark split them.  Raises
    ``ValueError`` when no chart has a file.
    """
    return read_files(spark, root, chart_files(listed_charts(spark, root)), multi_line).drop("_file")


def read_described_entries(
    spark: SparkSession, root: str, descriptors: str | None = None, multi_line: bool = True
) -> DataFrame:
    """The same rows for the charts, files and layouts that catalog and package descriptors declare."""
    return read_files(spark, root, chart_files(read_described_charts(spark, root, descriptors)), multi_line).drop("_file")


def read_tree_entries(
    spark: SparkSession, root: str, descriptors: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Entries by the descriptors where the tree has a catalog, by its metadata otherwise."""
    return read_files(spark, root, chart_files(tree_charts(spark, root, descriptors)), multi_line).drop("_file")
