"""toplist: ranked-chart analytics on Apache Spark.

Chart entries (who held which rank, on which chart, on which date) are kept
in a normalised, partitioned Parquet index and queried with lazy DataFrame
operators: typo-tolerant search, same-week-in-history, all-time peaks, the
chart of a date and a calendar of first number ones.  Catalog and Frictionless
descriptor tables are built from provider metadata.
"""

__version__ = "0.1.0"

from toplist.constants import (
    DEFAULT_ANNIVERSARY_RANK,
    DEFAULT_PEAK_RANK,
    FUZZY_DISTANCE_THRESHOLD,
)
from toplist.functions.normalize import normalize_column, normalize_text
from toplist.operators.anniversary import anniversary_batch, anniversary_hits
from toplist.operators.calendar import calendar_batch, ones_calendar
from toplist.operators.fuzzy_join import fuzzy_name_join, search_batch
from toplist.operators.index import (
    build_index,
    build_search_index,
    index_entries,
    read_index,
    write_index,
)
from toplist.operators.lookup import best_rank_in_year, search_hits, show_chart
from toplist.sources.catalog import (
    generate_frictionless_packages,
    list_charts,
    master_catalog,
    package_descriptors,
)

__all__ = [
    "DEFAULT_ANNIVERSARY_RANK",
    "DEFAULT_PEAK_RANK",
    "FUZZY_DISTANCE_THRESHOLD",
    "anniversary_batch",
    "anniversary_hits",
    "best_rank_in_year",
    "build_index",
    "build_search_index",
    "calendar_batch",
    "fuzzy_name_join",
    "generate_frictionless_packages",
    "index_entries",
    "list_charts",
    "master_catalog",
    "normalize_column",
    "normalize_text",
    "ones_calendar",
    "package_descriptors",
    "read_index",
    "search_batch",
    "search_hits",
    "show_chart",
    "write_index",
]
