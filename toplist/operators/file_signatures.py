"""Skipping index files by character signatures, for fuzzy search of one name.

A normalised name has only ``a-z``, ``0-9`` and ``&``; its signature is the set
of its characters as bits, and its length.  An edit brings in at most one new
character and takes out at most one, and changes the length by at most one.  So
two names within two edits differ by at most two lengths, two characters of one
side and two of the other.  Signatures of the (artist, song) pairs of every
index file are stored once, one row per distinct pair of signatures; a search
reads only files that have a pair it could match.

A file that the table does not know is always read, and a row for a file that is
gone is never looked at: a table that lags behind the index costs time, not rows.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toplist.functions.normalize import normalize_text
from toplist.operators.fuzzy_join import MAX_EDITS
from toplist.operators.lookup import search_hits
from toplist.operators.signatures import FIELDS
from toplist.schema import INDEX_COLUMNS, INDEX_SCHEMA
from toplist.sources.csv_tree import literal_glob

# The characters of normalised names, by bit.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789&"
_SCHEMA = ", ".join(["file string", *[f"{f}_mask long, {f}_length int" for f in FIELDS], "provider string", "year int"])


def character_mask(name: Column) -> Column:
    """The characters of a normalised name as bits of a bigint; null for null."""
    bits = [F.when(F.contains(name, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(ALPHABET)]
    return F.when(name.isNotNull(), reduce(lambda x, y: x.bitwiseOR(y), bits))


def literal_mask(name: str) -> int:
    return sum(1 << i for i, c in enumerate(ALPHABET) if c in name)


def may_match(field: str, name: str) -> Column:
    """Necessary condition on a file's signatures for a normalised name within two edits of ``name``."""
    mask, length = F.col(field + "_mask"), F.col(field + "_length")
    own = literal_mask(name)
    every = (1 << len(ALPHABET)) - 1
    return (
        length.between(len(name) - MAX_EDITS, len(name) + MAX_EDITS)
        & (F.bit_count(mask.bitwiseAND(F.lit(every & ~own))) <= MAX_EDITS)
        & (F.bit_count(F.bitwise_not(mask).bitwiseAND(F.lit(own))) <= MAX_EDITS)
    )


def _signatures(index: DataFrame) -> DataFrame:
    """Signature pairs of every file of an index scan."""
    names = index.select("provider", "year", F.col("_metadata.file_path").alias("file"), *FIELDS.values()).distinct()
    columns = []
    for field, name in FIELDS.items():
        columns += [character_mask(F.col(name)).alias(field + "_mask"), F.length(name).alias(field + "_length")]
    return names.select("file", *columns, "provider", "year").distinct()


def _scan(spark: SparkSession, index_path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(index_path)


def build_file_signatures(spark: SparkSession, index_path: str, path: str) -> None:
    """Write the signatures of all files of the index to ``path``."""
    _write(_signatures(_scan(spark, index_path)), path, "static")


def refresh_file_signatures(
    spark: SparkSession, index_path: str, path: str, partitions: list[tuple[str, int | None]]
) -> None:
    """Write the signatures of these (provider, year) directories of the index anew."""
    if partitions:
        here = [
            F.col("provider").eqNullSafe(F.lit(p)) & F.col("year").eqNullSafe(F.lit(y).cast("int")) for p, y in partitions
        ]
        _write(_signatures(_scan(spark, index_path).where(reduce(lambda x, y: x | y, here))), path, "dynamic")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    (
        rows.hint("rebalance", "provider", "year").write.mode("overwrite").option("partitionOverwriteMode", mode)
        .partitionBy("provider", "year").parquet(path)
    )


def files_to_read(
    spark: SparkSession, index_path: str, path: str, artist: str | None = None, song: str | None = None
) -> tuple[list[str], int]:
    """The index files that a search must read, and how many the index has (names of files: catalog metadata)."""
    # Listings write an empty authority as ``file:///``, rows' own files as ``file:/``.
    listed = [re.sub("^([A-Za-z][A-Za-z0-9+.-]*):///", r"\1:/", f) for f in _scan(spark, index_path).inputFiles()]
    tests = [may_match(field, normalize_text(raw)) for field, raw in (("artist", artist), ("song", song)) if raw]
    if not tests:
        return sorted(listed), len(listed)
    known = spark.read.schema(_SCHEMA).parquet(path)
    hit = F.coalesce(reduce(lambda x, y: x & y, tests), F.lit(False))
    # A file can be left out if it is known and none of its signature pairs can match.
    out = {r["file"] for r in known.groupBy("file").agg(F.max(hit).alias("hit")).where("not hit").select("file").collect()}
    return sorted(f for f in listed if f not in out), len(listed)


def search_skipping(
    spark: SparkSession, index_path: str, path: str, artist: str | None = None, song: str | None = None, **search: object
) -> DataFrame:
    """:func:`toplist.operators.lookup.search_hits` on the index at ``index_path``, reading only files that can match.

    ``path`` has the files' signatures; the other arguments are those of the search.
    """
    files, _ = files_to_read(spark, index_path, path, artist, song)
    if files:
        # The listing has URIs; a reader takes paths, in which some characters are patterns.
        reader = spark.read.schema(INDEX_SCHEMA).option("basePath", index_path)
        index = reader.parquet(*[literal_glob(unquote(f)) for f in files]).select(*INDEX_COLUMNS)
    else:
        index = spark.createDataFrame([], INDEX_SCHEMA).select(*INDEX_COLUMNS)
    return search_hits(index, artist, song, **search)
