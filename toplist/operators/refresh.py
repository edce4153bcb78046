"""Incremental index build: a manifest of source files tells which index directories to rebuild.

Beside the index lies a manifest, one row per source file: size, time,
checksum, the chart it belongs to, and the (provider, year) directories its rows
went to.  A refresh compares it with the tree as it is now:

* a file whose size, time and chart are as they were is taken as unchanged
  without being read; of the others the checksums are taken, and a file that was
  only touched is not read further;
* affected directories are those that changed or removed files had rows in, and
  those that changed files have rows in now;
* the files with rows in an affected directory are read, and exactly those
  directories are replaced; directories with no rows left are deleted;
* last, the new manifest is written.  A refresh that dies half-way left the old
  one in place, so the next one does the same directories again.

A first build reads the tree once and notes each file's directories in the same pass.

What is brought to the driver is catalog metadata: names of changed files,
affected directories, and in a first build the directories of every file.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toplist.operators.index import build_index
from toplist.session import written_once
from toplist.sources.catalog import below_root, root_path
from toplist.sources.csv_tree import chart_files, literal_glob, read_files, tree_charts
from toplist.sources.folders import Folder

PARTITION = T.StructType([T.StructField("provider", T.StringType()), T.StructField("year", T.IntegerType())])
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("parts", T.ArrayType(PARTITION)),
    ]
)


@dataclass
class Refresh:
    """What a refresh did: files by kind, directories (provider, year) replaced and deleted."""

    full: bool = False
    changed: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    touched: list[str] = field(default_factory=list)
    replaced: list[tuple[str, int | None]] = field(default_factory=list)
    deleted: list[tuple[str, int | None]] = field(default_factory=list)


def _manifest_folder(spark: SparkSession, path: str) -> Folder:
    return Folder(spark, path.rstrip("/") + ".manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest of the index at ``path``; ``None`` without one."""
    folder = _manifest_folder(spark, path)
    whole = [n for n in folder.names() if folder.has(f"{n}/_SUCCESS")]
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder.path}/{whole[-1]}") if whole else None


def _write_manifest(manifest: DataFrame, path: str) -> None:
    folder = _manifest_folder(manifest.sparkSession, path)
    before = folder.names()
    number = int(before[-1][1:]) + 1 if before else 1
    manifest.select(*MANIFEST_SCHEMA.names).write.parquet(f"{folder.path}/v{number:010d}")
    for name in before:
        folder.delete(name)


def _listing(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """``file, size, modified, tags`` of every file of the charts; no content is read."""
    named = files.where("path is not null").groupBy(F.col("_file").alias("file")).agg(
        F.sha2(
            F.to_json(F.sort_array(F.collect_set(F.struct("provider", "chart", "frequency", "fields")))), 256
        ).alias("tags")
    )
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.rstrip("/"))
        .select(
            below_root(F.col("path"), root_path(spark, root)).alias("file"),
            F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        )
    )
    return named.join(found, "file", "left")


def _checksums(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """``file, checksum`` of these files, by content."""
    where = [f"{root.rstrip('/')}/{n}" for n in names]
    contents = spark.read.format("binaryFile").load([literal_glob(w) for w in where])
    return contents.select(
        below_root(F.col("path"), root_path(spark, root)).alias("file"), F.sha2("content", 256).alias("checksum")
    )


def _named(files: DataFrame, names: list[str]) -> DataFrame:
    spark = files.sparkSession
    chosen = spark.createDataFrame([(n,) for n in names], "_file string")
    return files.join(chosen, "_file", "left_semi")


def _parts_of(entries: DataFrame) -> DataFrame:
    """``file, parts``: the index directories that each file's rows belong to."""
    pairs = entries.select("_file", F.struct("provider", F.year("date").alias("year")).alias("part")).distinct()
    return pairs.groupBy(F.col("_file").alias("file")).agg(F.sort_array(F.collect_list("part")).alias("parts"))


def refresh_search_index(
    spark: SparkSession, root: str, path: str, descriptors: str | None = None, multi_line: bool = True
) -> Refresh:
    """Bring the index at ``path`` up to date with the provider tree at ``root``.

    The result equals a full build of the tree.  Without a manifest, or without
    an index, it is one.  A tree without any file is an error, as in the build.
    """
    files = written_once(chart_files(tree_charts(spark, root, descriptors)), "refresh-files")
    now = written_once(_listing(spark, root, files), "refresh-listing")
    old = read_manifest(spark, path)
    index = Folder(spark, path.rstrip("/"))
    if old is None or not index.names():
        names = [r["file"] for r in now.select("file").collect()]
        # The rows are read once: what a file's rows belong to is noted as they pass (a few values per file).
        seen = Observation("refresh-parts")
        pairs = F.collect_set(F.struct(F.col("_file"), "provider", F.year("date").alias("year"))).alias("pairs")
        build_index(read_files(spark, root, files, multi_line).observe(seen, pairs).drop("_file"), path)
        # Without any row, and so without directories, nothing is noted.
        noted = seen.get["pairs"] if any("=" in n for n in index.names()) else []
        parts = spark.createDataFrame(
            [(r["_file"], (r["provider"], r["year"])) for r in noted],
            T.StructType([MANIFEST_SCHEMA["file"], T.StructField("part", PARTITION)]),
        ).groupBy("file").agg(F.sort_array(F.collect_list("part")).alias("parts"))
        manifest = now.join(_checksums(spark, root, names), "file", "left").join(parts, "file", "left")
        _write_manifest(manifest, path)
        return Refresh(full=True, changed=sorted(names))

    old = written_once(old, "refresh-manifest")
    before = old.select("file", *[F.col(c).alias("old_" + c) for c in MANIFEST_SCHEMA.names[1:]])
    both = now.join(before, "file", "full_outer")
    as_it_was = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("old_" + c)) for c in ("size", "modified", "tags")])
    removed = sorted(r["file"] for r in both.where("tags is null").select("file").collect())
    suspects = [r["file"] for r in both.where(F.col("tags").isNotNull() & ~as_it_was).select("file").collect()]
    if not removed and not suspects:
        return Refresh()
    none = spark.createDataFrame([], "file string, checksum string")
    sums = written_once(_checksums(spark, root, suspects) if suspects else none, "refresh-checksums")
    judged = written_once(
        both.where("tags is not null").join(sums, "file", "left")
        .withColumn("checksum", F.when(as_it_was, F.col("old_checksum")).otherwise(F.col("checksum")))
        .withColumn(
            "changed", ~(F.col("checksum").eqNullSafe(F.col("old_checksum")) & F.col("tags").eqNullSafe(F.col("old_tags")))
        ),
        "refresh-judged",
    )
    changed = sorted(r["file"] for r in judged.where("changed").select("file").collect())
    done = Refresh(changed=changed, removed=removed, touched=sorted(set(suspects) - set(changed)))

    fresh = spark.createDataFrame([], T.StructType([MANIFEST_SCHEMA["file"], MANIFEST_SCHEMA["parts"]]))
    if changed:
        fresh = written_once(_parts_of(read_files(spark, root, _named(files, changed), multi_line)), "refresh-parts")
    manifest = written_once(
        judged.join(fresh, "file", "left").withColumn(
            "parts", F.when(F.col("changed"), F.col("parts")).otherwise(F.col("old_parts"))
        ),
        "refresh-next",
    )
    lost = before.join(manifest.where("not changed").select("file"), "file", "left_anti").select(F.explode("old_parts").alias("part"))
    affected = lost.union(fresh.select(F.explode("parts").alias("part"))).select("part.*").distinct()
    affected = written_once(affected, "refresh-affected")
    kept = manifest.select("file", F.explode("parts").alias("part")).select("file", "part.*")
    hit = kept.join(
        affected.select(F.col("provider").alias("p"), F.col("year").alias("y")),
        F.col("provider").eqNullSafe(F.col("p")) & F.col("year").eqNullSafe(F.col("y")), "left_semi",
    )
    hit = written_once(hit, "refresh-hit")
    readers = sorted({r["file"] for r in hit.select("file").distinct().collect()})
    if readers:
        entries = read_files(spark, root, _named(files, readers), multi_line).drop("_file")
        entries = entries.join(
            affected.select(F.col("provider").alias("_p"), F.col("year").alias("_y")),
            (F.col("provider") == F.col("_p")) & F.year("date").eqNullSafe(F.col("_y")), "left_semi",
        )
        build_index(entries, path, only_present_partitions=True)
    present = {(r["provider"], r["year"]) for r in hit.select("provider", "year").distinct().collect()}
    every = {(r["provider"], r["year"]) for r in affected.collect()}
    order = lambda x: (x[0], x[1] is not None, x[1] or 0)
    done.replaced, done.deleted = sorted(present, key=order), sorted(every - present, key=order)
    for provider, year in done.deleted:
        index.delete(f"provider={index.escaped(provider)}/year={index.escaped(year)}")
    _write_manifest(manifest, path)
    return done
