"""Schemas shared by every operator.

The chart index is one denormalised relation: one row per chart entry, with
the provider/chart/frequency tags, the raw names, their normalised forms and
the date parts used for partition pruning.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Raw chart entries as they come from a source (CSV tree or derived feed).
ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("provider", T.StringType(), False),
        T.StructField("chart", T.StringType(), False),
        T.StructField("frequency", T.StringType(), True),
        T.StructField("date", T.DateType(), True),
        T.StructField("this_week", T.LongType(), True),
        T.StructField("artist", T.StringType(), True),
        T.StructField("song", T.StringType(), True),
    ]
)

# The search index. `provider` and `year` are the partition columns on disk.
INDEX_SCHEMA = T.StructType(
    list(ENTRY_SCHEMA.fields)
    + [
        T.StructField("artist_norm", T.StringType(), True),
        T.StructField("song_norm", T.StringType(), True),
        T.StructField("year", T.IntegerType(), True),
        T.StructField("month", T.IntegerType(), True),
        T.StructField("day", T.IntegerType(), True),
    ]
)

INDEX_COLUMNS = [f.name for f in INDEX_SCHEMA.fields]
INDEX_PARTITION_COLUMNS = ["provider", "year"]

# Result layouts of the public operators (column order is part of the API).
ANNIVERSARY_COLUMNS = ["provider", "chart", "frequency", "year", "artist", "song", "date"]
SEARCH_ROW_COLUMNS = ["provider", "chart", "date", "this_week", "artist", "song"]
BEST_COLUMNS = ["provider", "chart", "artist", "song", "best_rank", "best_date"]
SHOW_COLUMNS = ["provider", "chart", "this_week", "artist", "song", "date"]
CALENDAR_COLUMNS = ["week", "date", "original_date", "event"]
