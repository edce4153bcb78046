"""Helpers shared by the operators: words, stored intermediate tables, salted keys, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toplist.session import scratch_dir
from toplist.sources.tables import read_table

# The characters between words (space and \t to \r), as a class and as a list.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the runs of other than space and ``\\t``-``\\r``; empty for null or blank text."""
    # Splitting at one literal character avoids a regular-expression match per word.
    spaced = F.coalesce(text, F.lit(""))
    for gap in GAP_CHARS[1:]:
        spaced = F.replace(spaced, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    """Number of words, as long, without building them."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    gaps = F.regexp_count(bare, F.lit(GAP)).cast("long")
    return F.when(bare == "", F.lit(0).cast("long")).otherwise(gaps + 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage: later jobs read files that survive lost executors, and
    values that depend on how rows were dealt (ids, partition numbers) are
    fixed from here on.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted(many: DataFrame, key: str, per_task: int) -> tuple[DataFrame, DataFrame]:
    """``many`` with ``_salt``, which spreads hot keys, and the slices of every key (``key, _slices``) for ``spread``.

    A key with ``n`` rows is cut into ``ceil(n / per_task)`` slices.
    """
    slices = many.groupBy(key).count().select(key, F.ceil(F.col("count") / per_task).cast("int").alias("_slices"))
    dealt = many.join(slices.where("_slices > 1"), key, "left").withColumn(
        "_salt",
        F.when(F.col("_slices").isNull(), 0).otherwise(
            F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.col("_slices")).cast("int")
        ),
    )
    return dealt.drop("_slices"), slices


def spread(one: DataFrame, slices: DataFrame, key: str) -> DataFrame:
    """``one`` (``key`` is unique) with its rows repeated once per slice, numbered by ``_salt``."""
    return (
        one.join(slices, key)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
        .drop("_slices")
    )


def packed(df: DataFrame, columns: list[str], name: str) -> Column:
    """``columns`` of ``df`` as one struct, so that their names meet no others until they are selected back (``name.*``).

    Without columns, a struct of one null field named ``name``.
    """
    return (F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(None).alias(name))).alias(name)


def running_totals(rows: DataFrame, order: list[str], values: list[str], name: str) -> DataFrame:
    """``rows`` (narrow columns) with ``before_<value>``: its sum over all rows ahead in ``order``.

    The rows are range-partitioned once and stored with their partition number;
    each partition is summed, the partitions' totals are prefix-summed (one row
    per partition) and added to a window inside each partition, so no task
    holds more than one range.  ``order`` must be a total order.
    """
    blocks = stored(
        rows.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()), name
    )
    totals = blocks.groupBy("_block").agg(*[F.sum(v).alias("_" + v) for v in values])
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_block", *[F.coalesce(F.sum("_" + v).over(ahead), F.lit(0)).alias("_ahead_" + v) for v in values]
    )
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.join(F.broadcast(offsets), "_block")  # one row per range partition
    for v in values:
        own = F.coalesce(F.sum(v).over(inside), F.lit(0))
        summed = summed.withColumn("before_" + v, F.col("_ahead_" + v) + own)
    return summed.drop("_block", *["_ahead_" + v for v in values])
