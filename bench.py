"""Benchmark: build the chart index from a data directory, then time the queries.

Environment:
  BENCH_SF_DIR  data directory (default /root/testdata/sf0.1)
  BENCH_CPUS    local[N] executor threads (default 8)
  BENCH_RUNS    timed runs per query after one warm-up run (default 5; median kept)

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
``value`` is the sum of the per-query medians.  The index build is excluded
from it and reported as ``build_index_cold`` (the first job of the JVM, JIT
and code generation included) and ``build_index`` (a second build of the same
data).  Every query is fully executed into Spark's ``noop`` sink, so the time
is the engine's, not a driver collect's.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from toplist.operators.anniversary import anniversary_batch, anniversary_hits  # noqa: E402
from toplist.operators.calendar import calendar_batch, ones_calendar  # noqa: E402
from toplist.operators.fuzzy_join import fuzzy_name_join, search_batch  # noqa: E402
from toplist.operators.index import build_index, read_index  # noqa: E402
from toplist.operators.lookup import best_rank_in_year, search_hits, show_chart  # noqa: E402
from toplist.session import local_session, scratch_dir  # noqa: E402
from toplist.sources.feed import chart_feed  # noqa: E402
from toplist.sources.tables import read_table  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="toplist-bench")
    spark.sparkContext.setLogLevel("ERROR")

    t0 = time.perf_counter()
    build_index(chart_feed(spark, sf_dir), scratch_dir(spark, "bench-index"))
    build_cold = time.perf_counter() - t0
    t0 = time.perf_counter()
    path = scratch_dir(spark, "bench-index")
    build_index(chart_feed(spark, sf_dir), path)
    build = time.perf_counter() - t0
    index = read_index(spark, path)
    orders = read_table(spark, sf_dir, "orders")
    refs = (
        orders.where(F.year("o_orderdate") == 1998)
        .select(F.to_date("o_orderdate").alias("ref_date"))
        .distinct()
    )
    brand = F.col("p_brand")
    brand_typos = (
        read_table(spark, sf_dir, "part")
        .select(
            F.concat(
                F.substring(brand, 1, 1), F.substring(brand, 3, 1), F.substring(brand, 2, 1),
                F.substr(brand, F.lit(4)),
            ).alias("query")
        )
        .distinct()
    )
    names = index.select(F.col("song_norm").alias("name"))
    typos = names.select(F.concat(F.col("name"), F.lit("x")).alias("query"))

    suite = {
        "show_chart": lambda: show_chart(index, "1997-03-01"),
        "peak_year": lambda: best_rank_in_year(index, 1998),
        "anniversary": lambda: anniversary_hits(index, "1999-12-29"),
        "calendar": lambda: ones_calendar(index, year=2023),
        "search_artist": lambda: search_hits(index, artist="Brand#13"),
        "search_artist_song": lambda: search_hits(
            index, artist="The Brand#7 feat NATION_2", song="red plate"
        ),
        "search_best": lambda: search_hits(index, artist="Brand#21", best_position=True),
        "anniversary_batch": lambda: anniversary_batch(index, refs),
        "calendar_batch": lambda: calendar_batch(index, [2023, 2024, 2025]),
        "fuzzy_join": lambda: fuzzy_name_join(typos, names),
        "search_batch": lambda: search_batch(index, brand_typos),
    }
    times: dict[str, float] = {}
    for name, make in suite.items():
        _run(make())  # warm-up: codegen, file listing, JIT
        samples = []
        for _ in range(runs):
            t = time.perf_counter()
            _run(make())
            samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 4)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "chart_query_suite_total",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": {
            "build_index_cold": round(build_cold, 4),
            "build_index": round(build, 4),
            **times,
        },
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "index_rows": index.count(),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
