"""Write PLANS.md: the physical plan tree of each headline query on a stored index.

Usage: python tools/dump_plans.py [sf_dir]   (default /root/testdata/sf0.01)
"""

from __future__ import annotations

import sys

sys.path.insert(0, ".")

from pyspark.sql import functions as F  # noqa: E402

from toplist.operators.anniversary import anniversary_batch, anniversary_hits  # noqa: E402
from toplist.operators.calendar import calendar_batch, ones_calendar  # noqa: E402
from toplist.operators.covering import covering_dates  # noqa: E402
from toplist.operators.file_signatures import build_file_signatures, files_to_read  # noqa: E402
from toplist.operators.fuzzy_join import fuzzy_name_join, search_batch  # noqa: E402
from toplist.operators.history import chart_history  # noqa: E402
from toplist.operators.index import build_index, index_entries, read_index  # noqa: E402
from toplist.operators.lookup import best_rank_in_year, search_hits, show_chart  # noqa: E402
from toplist.operators.peaks import build_peaks, peaks_in_year  # noqa: E402
from toplist.operators.signatures import build_signatures, signature_name_join  # noqa: E402
from toplist.plans.inspect import plan_text  # noqa: E402
from toplist.session import local_session, scratch_dir  # noqa: E402
from toplist.sources.feed import chart_feed  # noqa: E402
from toplist.sources.tables import read_table  # noqa: E402


def _tree(df) -> str:
    text = plan_text(df, "formatted")
    tree = text.split("\n\n\n")[0].replace("== Physical Plan ==\n", "")
    scans = [b.strip() for b in text.split("\n\n") if b.strip().startswith("(") and "Scan parquet" in b]
    keep = []
    for b in scans:
        lines = [ln for ln in b.splitlines() if ln.startswith(("(", "PartitionFilters", "PushedFilters", "ReadSchema"))]
        keep.append("\n".join(lines))
    return tree + ("\n\n" + "\n\n".join(keep) if keep else "")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    path = scratch_dir(spark, "plans-index")
    build_index(chart_feed(spark, sf), path)
    index = read_index(spark, path)
    refs = (
        read_table(spark, sf, "orders").where(F.year("o_orderdate") == 1998)
        .select(F.to_date("o_orderdate").alias("ref_date")).distinct()
    )
    b = F.col("p_brand")
    brand_typos = read_table(spark, sf, "part").select(
        F.concat(F.substring(b, 1, 1), F.substring(b, 3, 1), F.substring(b, 2, 1), F.substr(b, F.lit(4))).alias("query")
    )
    names = index.select(F.col("song_norm").alias("name"))
    entries = chart_feed(spark, sf)
    stored = build_signatures(index, scratch_dir(spark, "plans-signatures"))
    asked = index.select("provider", "chart", F.date_add("date", 3).alias("ref_date"))
    peaks, masks = scratch_dir(spark, "plans-peaks"), scratch_dir(spark, "plans-files")
    build_peaks(index, peaks)
    build_file_signatures(spark, path, masks)
    shown = {
        "index build (before the write)": index_entries(
            entries.repartitionByRange("provider", F.year("date"), "chart", "date", "this_week", "artist", "song")
        ),
        "show_chart(index, '1997-03-01', provider='europe')": show_chart(index, "1997-03-01", provider="europe"),
        "best_rank_in_year(index, 1998)": best_rank_in_year(index, 1998),
        "anniversary_hits(index, '1999-12-29')": anniversary_hits(index, "1999-12-29"),
        "ones_calendar(index, year=2023)": ones_calendar(index, year=2023),
        "search_hits(index, artist='Brand#13')": search_hits(index, artist="Brand#13"),
        "search_hits(index, artist='Brand#21', best_position=True)": search_hits(index, artist="Brand#21", best_position=True),
        "anniversary_batch(index, order dates of 1998)": anniversary_batch(index, refs),
        "calendar_batch(index, [2023, 2024])": calendar_batch(index, [2023, 2024]),
        "fuzzy_name_join(typos, song names)": fuzzy_name_join(names.select(F.concat("name", F.lit("x")).alias("query")), names),
        "search_batch(index, brand typos)": search_batch(index, brand_typos),
        "signature_name_join(stored signatures, brand typos): the names are not exchanged": signature_name_join(
            stored, brand_typos, "artist"
        ),
        "covering_dates(index, dates), after the blocks are written": covering_dates(index, asked),
        "chart_history(index)": chart_history(index),
        "peaks_in_year(state, 1998, 10)": peaks_in_year(spark, peaks, 1998, 10),
    }
    out = [
        "# Physical plans",
        "",
        f"Generated by `tools/dump_plans.py {sf}` (AQE initial plans; scans show pruning and push-down).",
        "Two exchanges under a Sort over a filtered scan are deliberate: the first one lets the range",
        "sort sample the filtered rows instead of scanning the index a second time (`toplist/plans/ordering.py`).",
        "",
    ]
    for title, df in shown.items():
        out += [f"## {title}", "", "```", _tree(df), "```", ""]
    out += ["## Index files that search_skipping reads", ""]
    for artist, song in (("Brand#13", None), ("Brand#13 feat. NATION_5", "red plate"), (None, "Quixotic Jazz")):
        files, every = files_to_read(spark, path, masks, artist, song)
        out.append(f"* artist {artist!r}, song {song!r}: {len(files)} of {every}")
    with open("PLANS.md", "w", encoding="utf-8") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
