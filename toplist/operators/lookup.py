"""Filter-scan queries over the index: chart of a date, search, peaks.

Every operator takes the index as a DataFrame (a Parquet index, a derived
feed or a test frame) and returns a lazy DataFrame; parameters are folded
into the plan on the driver.  Empty string parameters mean "no filter".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toplist.constants import DEFAULT_PEAK_RANK, FUZZY_DISTANCE_THRESHOLD
from toplist.functions.dates import parse_date
from toplist.functions.fuzzy import dl_within_literal_parts
from toplist.functions.normalize import normalize_text
from toplist.plans.ordering import sorted_result
from toplist.schema import BEST_COLUMNS, SEARCH_ROW_COLUMNS, SHOW_COLUMNS

CHART_KEYS = ["provider", "chart", "artist", "song"]


def empty_like(index: DataFrame, columns: list[str]) -> DataFrame:
    """A typed, empty result with the operator's own columns (no rows scanned)."""
    return index.where(F.lit(False)).select(*columns)


def exact_filters(index: DataFrame, provider: str | None, chart: str | None) -> DataFrame:
    """Provider (partition column) and chart equality, each applied only if truthy."""
    if provider:
        index = index.where(F.col("provider") == provider)
    if chart:
        index = index.where(F.col("chart") == chart)
    return index


# Packing of (rank, date) into one bigint whose order is (rank, dated first, date):
# rank * 10^8 + (days since 1970-01-01 + 10^6), or + (10^8 - 1) for a null date.
# Day numbers of years 1..9999 lie in [-719162, 2932896], so the low part stays
# in [280838, 3932896] below the null code; ranks beyond +-9.2e10 overflow the
# bigint and fail loudly under ANSI arithmetic.
_RANK_SCALE = 100_000_000
_DAY_OFFSET = 1_000_000
_NO_DATE = _RANK_SCALE - 1


def packed_rank_date() -> Column:
    """Rank and date of a row as one bigint whose order is (rank, dated first, date); null without a rank."""
    day = F.coalesce(F.unix_date("date") + F.lit(_DAY_OFFSET), F.lit(_NO_DATE))
    return F.when(F.col("this_week").isNotNull(), F.col("this_week") * F.lit(_RANK_SCALE) + day)


def unpacked_rank_date(packed: str) -> tuple[Column, Column]:
    """``best_rank`` and ``best_date`` of a packed column."""
    low = F.pmod(F.col(packed), F.lit(_RANK_SCALE))
    rank = F.expr(f"({packed} - pmod({packed}, {_RANK_SCALE})) div {_RANK_SCALE}")
    return rank.alias("best_rank"), F.when(low != _NO_DATE, F.date_from_unix_date(low - F.lit(_DAY_OFFSET))).alias("best_date")


def best_rank(df: DataFrame, keys: list[str] = CHART_KEYS) -> DataFrame:
    """Per group: ``best_rank = min(this_week)`` and the earliest date at that rank.

    Rows with a null rank are ignored; among rows at the best rank the
    earliest non-null date wins, null when none is dated; a group with no
    ranked row gives (null, null).  Exact on ties, unlike ``min_by``.

    Rank and date are packed into one bigint ordered as (rank, dated first,
    date), so the whole thing is a single ``min`` over a fixed-width value:
    a partial+final *hash* aggregate (a struct minimum would force a sort
    aggregate, sorting every row before the shuffle).
    """
    return df.groupBy(*keys).agg(F.min(packed_rank_date()).alias("_best")).select(*keys, *unpacked_rank_date("_best"))


def show_chart(
    index: DataFrame, date_str: str | None, provider: str | None = None, chart: str | None = None
) -> DataFrame:
    """Every chart published exactly on ``date_str`` (no covering-week lookup)."""
    d = parse_date(date_str)
    if d is None:
        return empty_like(index, SHOW_COLUMNS)
    df = index.where((F.col("year") == d.year) & (F.col("date") == F.lit(d)))
    df = exact_filters(df, provider, chart)
    return sorted_result(df.select(*SHOW_COLUMNS), "provider", "chart", "this_week", "artist", "song")


def fuzzy_name_filter(artist: str | None, song: str | None) -> Column | None:
    """Conjunction of the fuzzy artist/song predicates for truthy parameters.

    Every field's cheap necessary condition comes before any field's exact
    test, so the expensive swap terms only run on rows that pass both bands.
    """
    cheap, exact = [], []
    for raw, column in ((artist, "artist_norm"), (song, "song_norm")):
        if raw:
            c, e = dl_within_literal_parts(column, normalize_text(raw), FUZZY_DISTANCE_THRESHOLD)
            cheap.append(c)
            exact.append(e)
    if not cheap:
        return None
    return reduce(lambda x, y: x & y, cheap + exact)


def search_hits(
    index: DataFrame,
    artist: str | None = None,
    song: str | None = None,
    date_str: str | None = None,
    year: int | None = None,
    best_position: bool = False,
    provider: str | None = None,
    chart: str | None = None,
) -> DataFrame:
    """Typo-tolerant search on artist and/or song, with exact filters.

    Rows mode returns ``provider, chart, date, this_week, artist, song``;
    best mode (``best_position`` and no ``date_str``) returns one row per
    (provider, chart, artist, song) with ``best_rank, best_date`` computed
    within the filtered rows.  A truthy but malformed date gives no rows.
    """
    df = exact_filters(index, provider, chart)
    # Cheap exact filters first: Catalyst keeps conjunct order, and the fuzzy
    # test is the expensive one.
    if date_str:
        d = parse_date(date_str)
        if d is None:
            return empty_like(index, SEARCH_ROW_COLUMNS)
        df = df.where((F.col("year") == d.year) & (F.col("date") == F.lit(d)))
    elif year is not None:
        df = df.where(F.col("year") == year)
    fuzzy = fuzzy_name_filter(artist, song)
    if fuzzy is not None:
        df = df.where(fuzzy)

    if best_position and date_str is None:
        return best_rank(df).orderBy(
            "provider", "chart", "best_date", "best_rank", "artist", "song"
        )
    return sorted_result(
        df.select(*SEARCH_ROW_COLUMNS), "provider", "chart", "date", "this_week", "artist", "song"
    )


def best_rank_in_year(
    index: DataFrame,
    year: int,
    max_rank: int = DEFAULT_PEAK_RANK,
    provider: str | None = None,
    chart: str | None = None,
) -> DataFrame:
    """Songs whose all-time best rank is ``<= max_rank`` and first reached in ``year``.

    The best rank is taken over all years; the year test applies to the
    aggregate (a later, better peak moves a song out of ``year``).  Rows
    ranked below ``max_rank`` are dropped *before* the aggregate: they can
    never be a group minimum that passes ``best_rank <= max_rank``, so the
    result is unchanged while the shuffle only carries top ranks and the
    predicate reaches the Parquet scan.
    """
    df = exact_filters(index, provider, chart).where(F.col("this_week") <= max_rank)
    return (
        best_rank(df)
        .where((F.col("best_rank") <= max_rank) & (F.year("best_date") == year))
        .select(*BEST_COLUMNS)
        .orderBy("provider", "chart", "artist", "best_rank", "song")
    )
