"""Command line: ``python -m toplist <command> ...``.

A thin shell over the API.  Commands: ``list``, ``anniversary``, ``search``,
``peak``, ``show``, ``calendar``, ``generate``, ``build-index``.  Results are
printed with ``DataFrame.show`` (``--rows`` caps the *display* only); the
calendar is also written as CSV (a directory of part files with headers,
in calendar order).
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import date

from toplist.constants import DEFAULT_ANNIVERSARY_RANK, DEFAULT_PEAK_RANK


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="toplist", description="Ranked-chart queries on Spark.")
    p.add_argument("--data", default="data", help="data root (provider folders)")
    p.add_argument("--index", default=None, help="index path (default: <data>/search_index)")
    p.add_argument("--rows", type=int, default=100, help="rows to display")
    sub = p.add_subparsers(dest="command", required=True)

    sub.add_parser("list", help="list all charts")

    a = sub.add_parser("anniversary", help="hits of this week in history")
    a.add_argument("--date", dest="date_str")
    a.add_argument("--rank", type=int, default=DEFAULT_ANNIVERSARY_RANK)
    a.add_argument("--provider")
    a.add_argument("--chart")

    s = sub.add_parser("search", help="fuzzy search by artist and/or song")
    s.add_argument("--artist")
    s.add_argument("--song")
    s.add_argument("--date", dest="date_str")
    s.add_argument("--year", type=int)
    s.add_argument("--provider")
    s.add_argument("--chart")
    s.add_argument("--best", dest="best_position", action="store_true")

    k = sub.add_parser("peak", help="songs first reaching their all-time best in a year")
    k.add_argument("--year", type=int, required=True)
    k.add_argument("--rank", type=int, default=DEFAULT_PEAK_RANK)
    k.add_argument("--provider")
    k.add_argument("--chart")

    w = sub.add_parser("show", help="the chart(s) of a date")
    w.add_argument("--date", dest="date_str", required=True)
    w.add_argument("--provider")
    w.add_argument("--chart")

    c = sub.add_parser("calendar", help="calendar of first number ones")
    c.add_argument("--provider")
    c.add_argument("--chart")
    c.add_argument("--year", type=int)
    c.add_argument("--output", help="CSV output directory (default: <year>_calendar.csv)")

    g = sub.add_parser("generate", help="write Frictionless descriptors")
    g.add_argument("--out", default=None, help="output folder (default: <data>/descriptors)")

    b = sub.add_parser("build-index", help="build the search index from the CSV files")
    b.add_argument("--descriptors", default=None, help="folder of written descriptors (default: <data>/descriptors)")
    b.add_argument("--single-line", action="store_true", help="fields hold no line breaks: split large files")
    return p


def chart_listing(charts):
    """Catalog listing for display: unknown start ``????``, open end ``Present``."""
    from pyspark.sql import functions as F

    return charts.select(
        "provider", "name", "title", "frequency",
        F.coalesce(F.nullif("start_date", F.lit("")), F.lit("????")).alias("start_date"),
        F.coalesce(F.nullif("end_date", F.lit("")), F.lit("Present")).alias("end_date"),
    )


def period_label(hits):
    """Anniversary rows with a display label of the chart period (``Jan 07``, ``Jan *``, ``Jan H2``)."""
    from pyspark.sql import functions as F

    month = F.date_format("date", "MMM")
    label = (
        F.when(F.col("frequency") == "monthly", F.concat(month, F.lit(" *")))
        .when(
            F.col("frequency") == "fortnightly",
            F.concat(month, F.when(F.dayofmonth("date") <= 14, F.lit(" H1")).otherwise(F.lit(" H2"))),
        )
        .otherwise(F.date_format("date", "MMM dd"))
    )
    return hits.withColumn("period", label)


def check_search_args(artist: str | None, song: str | None, date_str: str | None, year: int | None) -> str | None:
    """The command line's own rules: a name is required, date and year exclude each other."""
    if not artist and not song:
        return "search needs a name: give --artist, --song or both"
    if date_str and year:
        return "give either --date or --year, not both"
    return None


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "search":
        err = check_search_args(args.artist, args.song, args.date_str, args.year)
        if err:
            print(f"Error: {err}", file=sys.stderr)
            return 1

    from toplist.operators.anniversary import anniversary_hits
    from toplist.operators.calendar import ones_calendar
    from toplist.operators.index import build_search_index, read_index
    from toplist.operators.lookup import best_rank_in_year, search_hits, show_chart
    from toplist.session import command_session
    from toplist.sources.catalog import generate_frictionless_packages, list_charts

    spark = command_session()
    spark.sparkContext.setLogLevel("ERROR")
    index_path = args.index or os.path.join(args.data, "search_index")

    if args.command == "build-index":
        build_search_index(spark, args.data, index_path, args.descriptors, not args.single_line)
        return 0
    if args.command == "generate":
        generate_frictionless_packages(spark, args.data, args.out or os.path.join(args.data, "descriptors"))
        return 0
    if args.command == "list":
        df = chart_listing(list_charts(spark, args.data))
    else:
        index = read_index(spark, index_path)
        if args.command == "anniversary":
            df = period_label(
                anniversary_hits(index, args.date_str, args.rank, args.provider, args.chart)
            )
        elif args.command == "search":
            df = search_hits(
                index, args.artist, args.song, args.date_str, args.year,
                args.best_position, args.provider, args.chart,
            )
        elif args.command == "peak":
            df = best_rank_in_year(index, args.year, args.rank, args.provider, args.chart)
        elif args.command == "show":
            df = show_chart(index, args.date_str, args.provider, args.chart)
        else:
            year = args.year if args.year is not None else date.today().year
            df = ones_calendar(index, args.provider, args.chart, year)
            out = args.output or f"{year}_calendar.csv"
            df.write.mode("overwrite").option("header", True).csv(out)
    df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
