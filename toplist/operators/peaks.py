"""Best ranks kept up to date: a mergeable state beside the index, with retraction.

:func:`toplist.operators.lookup.best_rank` reads every entry.  Here its packed
minimum (rank, then date) is stored twice:

* ``partials``: per (provider, year) directory of the index, the minimum of each
  (chart, artist, song) there;
* ``peaks``: the minimum over all years, by (provider, slice of the names).

When directories of the index change, their partials are compared with the new
ones.  A group whose new partial is at or below its peak takes it; a group that
lost the rows its peak came from is computed again from the partials of the
other years; all others stay.  Only slices with a changed group are rewritten.
Peaks are written before partials, and every step gives the same result when it
is run again, so an update that died is repaired by running it again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toplist.operators.lookup import CHART_KEYS, packed_rank_date, unpacked_rank_date
from toplist.schema import BEST_COLUMNS
from toplist.session import written_once
from toplist.sources.folders import Folder

#: Slices of a provider's peaks.
DEFAULT_SLICES = 16
_PARTIALS = "chart string, artist string, song string, best long, provider string, year int"
_PEAKS = "chart string, artist string, song string, best long, provider string, slice int"


def _partials(index: DataFrame) -> DataFrame:
    return index.groupBy("provider", "year", "chart", "artist", "song").agg(F.min(packed_rank_date()).alias("best"))


def _merged(partials: DataFrame, slices: int) -> DataFrame:
    merged = partials.groupBy(*CHART_KEYS).agg(F.min("best").alias("best"))
    return merged.withColumn("slice", F.pmod(F.xxhash64("chart", "artist", "song"), F.lit(slices)).cast("int"))


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _write(rows: DataFrame, path: str, by: list[str], dynamic: bool) -> None:
    (
        rows.hint("rebalance", *by).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(*by).parquet(path)
    )


def build_peaks(index: DataFrame, path: str, slices: int = DEFAULT_SLICES) -> None:
    """Write the state of ``index`` to ``path``."""
    _write(_partials(index), f"{path}/partials", ["provider", "year"], dynamic=False)
    _write(_merged(_read(index.sparkSession, path, "partials"), slices), f"{path}/peaks", ["provider", "slice"], dynamic=False)
    index.sparkSession.createDataFrame([(slices,)], "slices int").write.mode("overwrite").parquet(f"{path}/spec")


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(_PARTIALS if table == "partials" else _PEAKS).parquet(f"{path}/{table}")


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """``provider, chart, artist, song, best_rank, best_date`` of every group, as ``best_rank`` gives for the index."""
    return _read(spark, path, "peaks").select(*CHART_KEYS, *unpacked_rank_date("best"))


def peaks_in_year(spark: SparkSession, path: str, year: int, max_rank: int) -> DataFrame:
    """:func:`toplist.operators.lookup.best_rank_in_year` from the stored state: a scan and two filters."""
    wanted = (F.col("best_rank") <= max_rank) & (F.year("best_date") == year)
    return read_peaks(spark, path).where(wanted).select(*BEST_COLUMNS).orderBy(
        "provider", "chart", "artist", "best_rank", "song"
    )


def update_peaks(spark: SparkSession, path: str, changed: DataFrame, partitions: list[tuple[str, int | None]]) -> None:
    """Bring the state up to date after the index's ``partitions`` were replaced by their rows in ``changed``.

    A partition without rows in ``changed`` is gone.  Rows of other partitions are not looked at.
    """
    if not partitions:
        return
    slices = spark.read.parquet(f"{path}/spec").first()["slices"]
    named = spark.createDataFrame([tuple(p) for p in partitions], "provider string, year int")
    of_these = lambda df: df.alias("x").join(
        F.broadcast(named.alias("p")), _same("x", "p", ["provider", "year"]), "left_semi"
    )
    keys = [*CHART_KEYS, "year"]
    new = written_once(_partials(of_these(changed)), "peaks-new")
    partials = _read(spark, path, "partials")
    old = of_these(partials)
    # What a group has in a replaced partition, before and now (null: nothing, or no ranked row).
    both = written_once(
        old.withColumn("is_old", F.lit(True)).unionByName(new.withColumn("is_old", F.lit(False)))
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("is_old"), F.col("best"))).alias("was"), F.min(F.when(~F.col("is_old"), F.col("best"))).alias("now"),
            F.count_if("is_old").alias("n_was"), F.count_if(~F.col("is_old")).alias("n_now"),
        )
        .where((~F.col("was").eqNullSafe(F.col("now"))) | (F.col("n_was") != F.col("n_now"))),
        "peaks-differing",
    )
    moved = both.groupBy(*CHART_KEYS).agg(F.min("was").alias("was"), F.min("now").alias("now"))
    peaks = _read(spark, path, "peaks")
    judged = written_once(
        moved.alias("m").join(peaks.alias("k"), _same("m", "k", CHART_KEYS), "left").select(
            *[F.col("m." + k).alias(k) for k in CHART_KEYS], F.col("m.now").alias("now"), F.col("k.best").alias("best"),
            # At or below the peak so far, a new partial is the peak whatever else there is.
            (F.col("m.now") <= F.col("k.best")).alias("takes"),
        ),
        "peaks-judged",
    )
    taken = judged.where("takes").select(*CHART_KEYS, F.col("now").alias("best"))
    again = judged.where("takes is null or not takes").select(*CHART_KEYS)
    # The others' rows may be gone: what is left of them in all partials as they will be.
    staying = partials.alias("x").join(F.broadcast(named.alias("p")), _same("x", "p", ["provider", "year"]), "left_anti")
    left = staying.unionByName(new.select(*staying.columns))
    left = left.alias("x").join(again.alias("g"), _same("x", "g", CHART_KEYS), "left_semi")
    settled = written_once(
        _merged(taken.unionByName(left.select(*CHART_KEYS, "best")), slices), "peaks-settled"
    )
    touched = judged.select("provider", F.pmod(F.xxhash64("chart", "artist", "song"), F.lit(slices)).cast("int").alias("slice")).distinct()
    kept = (
        peaks.alias("x").join(F.broadcast(touched.alias("t")), _same("x", "t", ["provider", "slice"]), "left_semi")
        .alias("x").join(judged.alias("j"), _same("x", "j", CHART_KEYS), "left_anti")
    )
    rewritten = written_once(kept.unionByName(settled.select(*kept.columns)), "peaks-rewritten")
    _write(rewritten, f"{path}/peaks", ["provider", "slice"], dynamic=True)
    _drop_empty(spark, f"{path}/peaks", ["provider", "slice"], touched, rewritten)
    _write(new, f"{path}/partials", ["provider", "year"], dynamic=True)
    _drop_empty(spark, f"{path}/partials", ["provider", "year"], named, new)


def _drop_empty(spark: SparkSession, path: str, by: list[str], asked: DataFrame, rows: DataFrame) -> None:
    """Delete the directories of ``asked`` that ``rows`` has nothing for (directory names: catalog metadata)."""
    folder = Folder(spark, path)
    filled = {tuple(r) for r in rows.select(*by).distinct().collect()}
    for key in {tuple(r) for r in asked.select(*by).collect()} - filled:
        folder.delete("/".join(f"{c}={folder.escaped(v)}" for c, v in zip(by, key, strict=True)))
