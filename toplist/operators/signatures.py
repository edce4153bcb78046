"""A stored inverted index of name signatures, for set-valued fuzzy search without touching the names.

:func:`fuzzy_name_join` explodes the signatures of both sides on every call.
Here those of the index names are written once: one row per (field, provider,
year, name, key), a Parquet table partitioned by field, provider and year and
*bucketed by key*.  A search explodes the queries' signatures alone, deals them
by key to as many partitions as there are buckets, and each meets its bucket in
a merge join -- the stored side is neither exploded nor exchanged, whatever its
size.  Candidates are de-duplicated by an aggregate and checked exactly.

Partitions follow the index's own directories, so when a (provider, year) of the
index is rebuilt, only its keys are; names that several partitions share meet a
query once per partition and are de-duplicated as candidates.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toplist.functions.fuzzy import dl_within2_columns
from toplist.operators.fuzzy_join import (
    DEFAULT_MAX_DELETE_LEN,
    MAX_EDITS,
    deletion_keys,
    name_segment_keys,
    query_segment_keys,
)

#: Name columns of the index that have signatures, by field.
FIELDS = {"artist": "artist_norm", "song": "song_norm"}
#: Buckets of a new table: about one per task that a search should have.
DEFAULT_BUCKETS = 32
_PARTITIONS = ["field", "provider", "year"]
_MIN_SEGMENT_LEN = DEFAULT_MAX_DELETE_LEN - MAX_EDITS + 1


@dataclass(frozen=True)
class SignatureIndex:
    """A signature table in the session's catalog, with its folder and number of buckets."""

    table: str
    path: str
    buckets: int


def _keys(name: Column, segments: Column) -> Column:
    """64-bit signature keys: deletion keys of short strings, segment keys of long ones (both near the border)."""
    none = F.array().cast("array<bigint>")
    deletions = F.transform(deletion_keys(name), lambda k: F.xxhash64(F.lit("d"), k))
    pieces = F.transform(segments, lambda k: F.xxhash64(F.lit("s"), k))
    n = F.length(name)
    return F.array_distinct(
        F.concat(
            F.when(n <= DEFAULT_MAX_DELETE_LEN, deletions).otherwise(none),
            F.when(n >= _MIN_SEGMENT_LEN, pieces).otherwise(none),
        )
    )


def _rows(index: DataFrame, buckets: int) -> DataFrame:
    """Signature rows of the index's distinct names, dealt like the buckets."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("name")) for f, c in FIELDS.items()]))
    names = index.select("provider", "year", named.alias("n")).select("n.field", "provider", "year", "n.name")
    names = names.where("name is not null").distinct()
    keys = _keys(F.col("name"), name_segment_keys(F.col("name"), _MIN_SEGMENT_LEN))
    exploded = names.select(F.explode(keys).alias("key"), "name", *_PARTITIONS)
    # A task holds one bucket, so each directory gets one file a bucket.
    return exploded.repartition(buckets, "key")


def build_signatures(
    index: DataFrame, path: str, table: str | None = None, buckets: int = DEFAULT_BUCKETS
) -> SignatureIndex:
    """Write the signatures of all names of ``index`` to ``path`` and enter them in the catalog."""
    table = table or f"signatures_{uuid.uuid4().hex}"
    (
        _rows(index, buckets)
        .write.mode("overwrite")
        .partitionBy(*_PARTITIONS)
        .bucketBy(buckets, "key")
        .sortBy("key")
        .option("path", path)
        .saveAsTable(table)
    )
    return SignatureIndex(table, path, buckets)


def open_signatures(
    spark: SparkSession, path: str, table: str | None = None, buckets: int = DEFAULT_BUCKETS
) -> SignatureIndex:
    """Enter a table that an earlier session wrote (with as many ``buckets``) in this session's catalog."""
    table = table or f"signatures_{uuid.uuid4().hex}"
    place = path.replace("'", "''")
    spark.sql(
        f"CREATE TABLE {table} (key BIGINT, name STRING, field STRING, provider STRING, year INT) USING parquet "
        f"PARTITIONED BY (field, provider, year) CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS "
        f"LOCATION '{place}'"
    )
    spark.catalog.recoverPartitions(table)
    return SignatureIndex(table, path, buckets)


@contextmanager
def _replacing_present_partitions(spark: SparkSession):
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def refresh_signatures(
    signatures: SignatureIndex, changed: DataFrame, removed: list[tuple[str | None, int | None]] = ()
) -> None:
    """Rebuild the signatures of the (provider, year) partitions in ``changed``; drop those in ``removed``.

    ``changed`` has all index rows of its partitions.  Nothing else is read or written.
    """
    spark = changed.sparkSession
    with _replacing_present_partitions(spark):
        _rows(changed, signatures.buckets).write.insertInto(signatures.table, overwrite=True)
    literal = lambda x: "null" if x is None else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    for provider, year in removed:
        for field in FIELDS:
            spec = f"field='{field}', provider={literal(provider)}, year={literal(year)}"
            spark.sql(f"ALTER TABLE {signatures.table} DROP IF EXISTS PARTITION ({spec})")


def signature_name_join(
    signatures: SignatureIndex, queries: DataFrame, field: str, query_col: str = "query"
) -> DataFrame:
    """Distinct ``(query, name)`` with ``damerau_levenshtein(query, name) <= 2`` over the stored names of ``field``.

    Equal to :func:`toplist.operators.fuzzy_join.fuzzy_name_join` on all names
    of the index; queries are compared as given (pass normalised strings).
    """
    if field not in FIELDS:
        raise ValueError(f"no signatures of {field!r}; there are {sorted(FIELDS)}")
    names = queries.sparkSession.table(signatures.table).where(F.col("field") == field).select("key", "name")
    q = queries.select(F.col(query_col).alias("query")).where("query is not null").distinct()
    asked = q.select("query", F.explode(_keys(F.col("query"), query_segment_keys(F.col("query")))).alias("key"))
    # Exploded keys are more than the planner can tell, so they never go out as a broadcast.
    met = asked.hint("merge").join(names.hint("merge"), "key")
    once = met.groupBy("query", "name").agg(F.count("*").alias("shared"))
    # The check depends on the aggregate's own column, so it cannot move below the de-duplication.
    close = F.when(F.col("shared") > 0, dl_within2_columns(F.col("query"), F.col("name"))).otherwise(F.lit(False))
    return once.where(close).select("query", "name")
