"""Chart entries -> a provider tree of annual CSV files with metadata, the layout that :mod:`csv_tree` reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplist.session import scratch_dir
from toplist.sources.folders import Folder

COLUMNS = ["date", "this_week", "artist", "song"]


def write_csv_tree(entries: DataFrame, root: str) -> None:
    """Write ``<root>/<provider>/<chart>/<year>.csv`` for every chart year in ``entries``, and the providers' metadata.

    A chart year is one file, written by one task (annual files are small);
    files of other years and charts stay.  Rows without a date go to
    ``undated.csv``.  The metadata of a provider lists the charts in
    ``entries`` and those it listed before.
    """
    spark = entries.sparkSession
    staged = scratch_dir(spark, "csv-tree")
    keyed = entries.withColumn("_year", F.year("date"))
    dealt = keyed.select(*COLUMNS, *[F.col(c).alias("_" + c) for c in ("provider", "chart")], "_year")
    keys = ["_provider", "_chart", "_year"]
    (
        dealt.repartition(*keys).sortWithinPartitions(*keys, "date", "this_week", "artist", "song")
        .write.partitionBy(*keys)
        .option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(staged)
    )
    # One name per chart year: catalog metadata.
    frequency = {
        (r["provider"], r["chart"]): r["frequency"]
        for r in entries.groupBy("provider", "chart").agg(F.first("frequency").alias("frequency")).collect()
    }
    folder, target = Folder(spark, staged), Folder(spark, root.rstrip("/"))
    providers = [n for n in folder.names() if n.startswith("_provider=")]
    for p in providers:
        provider = folder.unescaped(p)
        place = target.below(provider)
        place.make()
        for c in folder.below(p).names():
            chart = folder.unescaped(c)
            place.below(chart).make()
            for y in folder.below(f"{p}/{c}").names():
                source = folder.below(f"{p}/{c}/{y}")
                (part,) = [n for n in source.names() if n.endswith(".csv")]
                place.below(chart).take(source, part, f"{folder.unescaped(y) or 'undated'}.csv")
        _describe(place, provider, {c: f for (q, c), f in frequency.items() if q == provider})


def _describe(place: Folder, provider: str, charts: dict[str, str]) -> None:
    """The provider's metadata document."""
    name = f"{provider}-metadata.json"
    known = json.loads(place.read(name))["charts"] if place.has(name) else []
    listed = {c["prefix"]: c for c in known} | {
        chart: {
            "name": chart, "folder": chart, "prefix": chart, "frequency": frequency, "start_date": "", "fields": COLUMNS,
        }
        for chart, frequency in charts.items()
    }
    document = {"name": provider, "prefix": provider, "charts": [listed[c] for c in sorted(listed)]}
    place.write(name, json.dumps(document, ensure_ascii=False))
