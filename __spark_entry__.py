"""

The data directories hold TPC-H style sales tables, not charts, so every
query runs on the chart feed Spark derives from them
(:mod:`toplist.sources.feed`), normalised into index rows in the same plan.
Each oracle restates the feed and the query in plain SQL, independently of
the Spark code (window-min + FILTER for best ranks, ``damerau_levenshtein``
for fuzzy matching, date arithmetic for week bounds).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toplist.functions.normalize import fold_ascii_column
from toplist.operators.anniversary import anniversary_batch, anniversary_hits
from toplist.operators.audit import audit_index
from toplist.operators.calendar import calendar_batch, ones_calendar
from toplist.operators.covering import covering_dates, show_covering
from toplist.operators.file_signatures import build_file_signatures, search_skipping
from toplist.operators.fuzzy_join import fuzzy_name_join, search_batch
from toplist.operators.history import chart_history
from toplist.operators.index import build_index, index_entries, read_index
from toplist.operators.lookup import best_rank_in_year, search_hits, show_chart
from toplist.operators.peaks import build_peaks, peaks_in_year, read_peaks, update_peaks
from toplist.operators.refresh import refresh_search_index
from toplist.operators.signatures import build_signatures, refresh_signatures, signature_name_join
from toplist.operators.variants import best_rank_of_variants
from toplist.session import scratch_dir, written_once
from toplist.sources.feed import chart_feed
from toplist.sources.folders import Folder
from toplist.sources.tables import read_table
from toplist.sources.tree_writer import write_csv_tree

try:
    import corpus_pipeline
    from toplist.llm import queries as llm
except ModuleNotFoundError as error:
    # Only the corpus subpackage and its pipeline may be absent.
    if not (error.name or "").startswith(("corpus_pipeline", "toplist.llm")):
        raise
    corpus_pipeline = llm = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _index(spark: SparkSession, sf_dir: str, snap: bool = True) -> DataFrame:
    return index_entries(chart_feed(spark, sf_dir, snap=snap))


def _stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived index written and read as searches read it: partitioned Parquet in the shared folder."""
    path = scratch_dir(spark, "search-index")
    build_index(chart_feed(spark, sf_dir), path)
    return read_index(spark, path)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: all-time peaks first reached in 1998 (top 10), on the sf0.001 feed."""
    return best_rank_in_year(_index(spark, SMOKE_DIR), 1998, 10)


def _order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return orders.select(F.to_date("o_orderdate").alias("ref_date")).distinct()


def _order_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))


def _field_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches made of parts: misspelt brand and name, and for some a provider and a year."""
    part = read_table(spark, sf_dir, "part")
    b, n = F.col("p_brand"), F.col("p_name")
    artist = F.when(F.col("p_partkey") % 5 != 0, F.concat(b, F.lit("x")))
    song = F.when(F.col("p_partkey") % 5 != 1, F.concat(F.substring(n, 1, 2), F.substr(n, F.lit(4))))
    provider = F.when(F.col("p_partkey") % 2 == 0, F.lit("asia"))
    year = F.when(F.col("p_partkey") % 3 == 0, F.lit(1997))
    return part.select(
        artist.alias("artist"), song.alias("song"), provider.alias("provider"), year.alias("year"),
        F.concat_ws("/", artist, song, provider, year.cast("string")).alias("query"),
    ).distinct()


def _text_words(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Distinct words of a table's texts, lower-cased and folded to ASCII; ASCII characters that are no letters part them."""
    words = read_table(spark, sf_dir, table).select(
        F.explode(F.split(F.lower("text"), r"[\x00-\x60\x7b-\x7f]+")).alias("word")
    )
    return words.distinct().select(fold_ascii_column(F.col("word")).alias("word")).where("word <> ''").distinct()


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = _index(spark, sf_dir)
    return (
        idx.select(F.col("artist").alias("name"), F.col("artist_norm").alias("name_norm"))
        .union(idx.select(F.col("song").alias("name"), F.col("song_norm").alias("name_norm")))
        .distinct()
    )


def _typo_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt song queries derived from part names (see oracle for the rule)."""
    part = read_table(spark, sf_dir, "part")
    name = F.regexp_replace(F.lower("p_name"), "[^a-z0-9&]", "")
    k = F.col("p_partkey") % 3
    typo = (
        F.when(k == 0, F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substr(name, F.lit(3))))
        .when(k == 1, F.concat(F.substring(name, 1, 2), F.substr(name, F.lit(4))))
        .otherwise(F.concat(name, F.lit("s")))
    )
    return part.select(typo.alias("query")).distinct()


def _brand_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt artist queries: each brand with its 2nd and 3rd characters swapped."""
    part = read_table(spark, sf_dir, "part")
    b = F.col("p_brand")
    typo = F.concat(F.substring(b, 1, 1), F.substring(b, 3, 1), F.substring(b, 2, 1), F.substr(b, F.lit(4)))
    return part.select(typo.alias("query")).distinct()


#: The (provider, year) partitions that the maintenance queries change after a first build.
_LATE, _REVISED, _GONE = ("asia", 1997), ("europe", 1996), ("nowhere", 1990)


def _is(partition: tuple[str, int]) -> Column:
    return (F.col("provider") == partition[0]) & (F.col("year") == partition[1])


def _before_revision(index: DataFrame) -> DataFrame:
    """An earlier state of ``index``: one partition not yet there, one with other ranks and names, one that goes later."""
    revised = (F.col("year") == _REVISED[1]) & (F.col("provider") == _REVISED[0])
    early = index.where(~_is(_LATE)).withColumns(
        {
            "this_week": F.when(revised, F.lit(1).cast("long")).otherwise(F.col("this_week")),
            "song_norm": F.when(revised, F.concat(F.lit("zz"), "song_norm")).otherwise(F.col("song_norm")),
        }
    )
    gone = index.where(_is(_REVISED)).withColumns({"provider": F.lit(_GONE[0]), "year": F.lit(_GONE[1])})
    return early.unionByName(gone)


def _signature_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of an earlier state, refreshed by partition; then the names that misspelt songs match."""
    index = written_once(_index(spark, sf_dir), "index-rows")
    stored = build_signatures(_before_revision(index), scratch_dir(spark, "signatures"))
    refresh_signatures(stored, index.where(_is(_LATE) | _is(_REVISED)), removed=[_GONE])
    return signature_name_join(stored, _typo_queries(spark, sf_dir), "song")


def _search_batch_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _stored_index(spark, sf_dir)
    stored = build_signatures(index, scratch_dir(spark, "signatures"))
    return search_batch(
        index, _field_queries(spark, sf_dir), name_join=lambda q, field: signature_name_join(stored, q, field)
    )


def _search_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, signatures = scratch_dir(spark, "search-index"), scratch_dir(spark, "file-signatures")
    build_index(chart_feed(spark, sf_dir), path)
    build_file_signatures(spark, path, signatures)
    return search_skipping(spark, path, signatures, artist="Brand#13 feat. NATION_5", song="red plate")


def _index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider tree of the feed, indexed; one chart's files rewritten, another's removed; the refreshed index."""
    feed = written_once(chart_feed(spark, sf_dir), "feed")
    tree, path = scratch_dir(spark, "provider-tree"), scratch_dir(spark, "search-index")
    write_csv_tree(feed, tree)
    refresh_search_index(spark, tree, path)
    changed = feed.where((F.col("chart") == "asia-economy") & (F.year("date") >= 1997))
    write_csv_tree(changed.withColumn("artist", F.concat("artist", F.lit(" Band"))), tree)
    folder = Folder(spark, f"{tree}/europe/europe-promo")
    for name in folder.names():
        if name.startswith(("1996", "1997")):
            folder.delete(name)
    refresh_search_index(spark, tree, path)
    return read_index(spark, path)


def _maintained_peaks(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a peak state that was built on an earlier index and then updated."""
    index = written_once(_index(spark, sf_dir), "index-rows")
    path = scratch_dir(spark, "peaks")
    build_peaks(_before_revision(index), path)
    update_peaks(spark, path, index.where(_is(_LATE) | _is(_REVISED)), [_LATE, _REVISED, _GONE])
    return path


def _chart_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's date, asked of the standard and promo chart of its customer's region."""
    orders, customer = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    provider = F.lower(F.regexp_replace("r_name", " ", "-"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "standard").otherwise("promo")
    return joined.select(
        F.to_date("o_orderdate").alias("ref_date"), provider.alias("provider"), F.concat(provider, F.lit("-"), kind).alias("chart")
    ).distinct()


def _feed_sizes(index: DataFrame) -> DataFrame:
    """Two validity periods for every chart of the feed: sizes by the length of its name, then one size for all."""
    charts = index.select("provider", "chart").distinct()
    first = charts.select(
        "provider", "chart", F.lit(None).cast("date").alias("start"), F.lit("1996-06-30").cast("date").alias("end"),
        (F.length("chart") % 5 + 3).cast("bigint").alias("size"),
    )
    then = charts.select(
        "provider", "chart", F.lit("1996-07-01").cast("date").alias("start"), F.lit(None).cast("date").alias("end"),
        F.lit(12).cast("bigint").alias("size"),
    )
    return first.unionByName(then)


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = written_once(_index(spark, sf_dir).drop("artist_norm", "song_norm"), "index-rows")
    # A week in five is not there, and one rank in seven is another's.
    weeks = index.where((F.col("frequency") != "weekly") | (F.weekofyear("date") % 5 != 0))
    shifted = F.when(F.col("this_week") % 7 == 0, F.col("this_week") - 1).otherwise(F.col("this_week"))
    return audit_index(weeks.withColumn("this_week", shifted), _feed_sizes(index)).fillna(0, ["this_week", "entries"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _chart_queries() | ({} if llm is None else llm.QUERIES | {"pipeline": corpus_pipeline.run})


def _chart_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    today = date(2024, 1, 7)
    return {
        "show_chart_date": lambda s, d: show_chart(_index(s, d), "1997-03-01"),
        "show_chart_provider_chart": lambda s, d: show_chart(
            _index(s, d), "1998-06-13", provider="europe", chart="europe-standard"
        ),
        "peak_year_default": lambda s, d: best_rank_in_year(_index(s, d), 1998),
        "peak_year_rank5_chart": lambda s, d: best_rank_in_year(
            _index(s, d), 1999, 5, chart="asia-promo"
        ),
        "anniversary_weekly": lambda s, d: anniversary_hits(_index(s, d), "1999-03-10"),
        "anniversary_wrapped": lambda s, d: anniversary_hits(_index(s, d), "1999-12-29"),
        "anniversary_monthly": lambda s, d: anniversary_hits(
            _index(s, d), "1998-07-20", chart="europe-economy"
        ),
        "anniversary_fortnight_h1": lambda s, d: anniversary_hits(_index(s, d), "1997-05-03"),
        "anniversary_fortnight_h2": lambda s, d: anniversary_hits(_index(s, d), "1997-05-20"),
        "anniversary_rank5_provider": lambda s, d: anniversary_hits(
            _index(s, d), "1998-10-14", rank=5, provider="america"
        ),
        "anniversary_today": lambda s, d: anniversary_hits(_index(s, d), None, today=today),
        "calendar_leap": lambda s, d: ones_calendar(_index(s, d, snap=False), year=2024),
        "calendar_common": lambda s, d: ones_calendar(_index(s, d, snap=False), year=2023),
        "calendar_provider": lambda s, d: ones_calendar(
            _index(s, d, snap=False), provider="asia", year=2023
        ),
        "index_columns": lambda s, d: _index(s, d),
        "normalize_names": _name_pairs,
        "search_rows_artist": lambda s, d: search_hits(_stored_index(s, d), artist="Brand#13"),
        "search_rows_song": lambda s, d: search_hits(_stored_index(s, d), song="smal ring"),
        "search_artist_and_song": lambda s, d: search_hits(
            _stored_index(s, d), artist="The Brand#7 feat NATION_2", song="red plate"
        ),
        "search_on_date": lambda s, d: search_hits(
            _stored_index(s, d), artist="brand#2", date_str="1997-03-01"
        ),
        "search_best_all": lambda s, d: search_hits(
            _stored_index(s, d), artist="Brand#21", best_position=True
        ),
        "search_best_in_year": lambda s, d: search_hits(
            _stored_index(s, d), song="hot plate (live)", year=1998, best_position=True
        ),
        "search_transposed_query": lambda s, d: search_hits(_stored_index(s, d), artist="Rbadn#11"),
        "search_filters_only": lambda s, d: search_hits(
            _index(s, d), provider="africa", chart="africa-large", year=1996
        ),
        "peak_year_provider": lambda s, d: best_rank_in_year(
            _index(s, d), 1997, 3, provider="middle-east"
        ),
        "calendar_chart": lambda s, d: ones_calendar(
            _index(s, d, snap=False), chart="america-promo", year=2025
        ),
        "search_best_provider_chart": lambda s, d: search_hits(
            _stored_index(s, d), song="small widget", provider="asia", chart="asia-standard",
            best_position=True,
        ),
        "search_song_in_year": lambda s, d: search_hits(
            _stored_index(s, d), song="blue bolt", year=2000
        ),
        "anniversary_batch": lambda s, d: anniversary_batch(_index(s, d), _order_dates(s, d)),
        "calendar_batch": lambda s, d: calendar_batch(
            _index(s, d, snap=False), [2023, 2024], provider="europe"
        ),
        "calendar_batch_years": lambda s, d: calendar_batch(_index(s, d, snap=False), _order_years(s, d)),
        "search_batch_fields": lambda s, d: search_batch(_stored_index(s, d), _field_queries(s, d)),
        "fuzzy_join_words": lambda s, d: fuzzy_name_join(
            _text_words(s, d, "benchmark"), _text_words(s, d, "documents"), "word", "word"
        ),
        "signature_name_join": lambda s, d: signature_name_join(
            build_signatures(_index(s, d), scratch_dir(s, "signatures")), _typo_queries(s, d), "song"
        ),
        "signature_refresh": _signature_refresh,
        "search_batch_stored": _search_batch_stored,
        "search_skipping": _search_skipping,
        "index_refresh": _index_refresh,
        "peaks_maintained": lambda s, d: read_peaks(s, _maintained_peaks(s, d)),
        "peaks_maintained_year": lambda s, d: peaks_in_year(s, _maintained_peaks(s, d), 1998, 10),
        "covering_dates": lambda s, d: covering_dates(_index(s, d), _chart_questions(s, d)),
        "show_covering": lambda s, d: show_covering(_index(s, d), _chart_questions(s, d), max_rank=3),
        # A missing last week is written as 0: result sets are compared without nullable whole numbers.
        "chart_history": lambda s, d: chart_history(written_once(chart_feed(s, d), "feed")).fillna(0, ["last_week"]),
        "audit_index": _audit,
        "best_rank_of_variants": lambda s, d: best_rank_of_variants(
            written_once(_index(s, d), "index-rows"), fields=("song",), min_length=10
        ),
        "search_batch": lambda s, d: search_batch(_stored_index(s, d), _brand_typos(s, d)),
        "fuzzy_join": lambda s, d: fuzzy_name_join(
            _typo_queries(s, d), _index(s, d).select(F.col("song_norm").alias("name")),
            "query", "name",
        ),
    }


# ---------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------


def _norm_sql(x: str) -> str:
    # strip_accents covers the only accent in the feed; NFKD-only cases are golden tests.
    s = f"strip_accents(lower({x}))"
    s = rf"regexp_replace({s}, '[\(\[].*?[\)\]]', '', 'g')"
    s = rf"regexp_replace({s}, '^(the|a|an|el|la|los|las|un|una)\s+', '')"
    s = rf"regexp_replace({s}, '\b(and|with|feat|ft|featuring|pres|presents|y|con|e|et)\b', '&', 'g')"
    return rf"regexp_replace({s}, '[^a-z0-9&]', '', 'g')"


def _feed_sql(snap: bool = True) -> str:
    if snap:
        chart_date = """case frequency when 'weekly' then cast(date_trunc('week',sd) as date)+5
      when 'monthly' then cast(date_trunc('month',sd) as date)
      else cast(date_trunc('month',sd) as date) + case when day(sd)<=14 then 0 else 14 end end"""
    else:
        chart_date = "sd"
    return f"""
e as (
  select lower(replace(r_name,' ','-')) provider, lower(p_type) ct,
    case when p_type in ('ECONOMY','MEDIUM') then 'monthly'
         when p_type='PROMO' then 'fortnightly' else 'weekly' end frequency,
    cast(l_shipdate as date) sd,
    case p_partkey % 4 when 0 then concat('The ', p_brand)
         when 1 then concat(p_brand,' feat. ',n_name)
         when 2 then concat('Éd ',p_brand) else p_brand end artist,
    case when p_size % 3 = 0 then concat(p_name,' (Remix)') else p_name end song,
    l_quantity
  from lineitem join part on l_partkey=p_partkey join supplier on l_suppkey=s_suppkey
  join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey),
g as (
  select provider, concat(provider,'-',ct) chart, frequency, {chart_date} as date,
    artist, song, sum(l_quantity) units
  from e group by 1,2,3,4,5,6),
feed as (
  select provider, chart, frequency, date, artist, song,
    cast(row_number() over (partition by chart, date order by units desc, artist, song) as bigint) this_week
  from g),
idx as (
  select provider, chart, frequency, date, this_week, artist, song,
    {_norm_sql('artist')} as artist_norm, {_norm_sql('song')} as song_norm,
    cast(year(date) as integer) as year, cast(month(date) as integer) as month,
    cast(day(date) as integer) as day
  from feed)"""


def _with(body: str, snap: bool = True, extra: str = "") -> str:
    return f"with {_feed_sql(snap)}{extra}\n{body}"


def _best_sql(where: str = "true") -> str:
    return f""",
r as (select * from idx where {where}),
t as (select *, min(this_week) over (partition by provider, chart, artist, song) mn from r),
best as (
  select provider, chart, artist, song, min(this_week) as best_rank,
    min(date) filter (where this_week = mn) as best_date
  from t group by provider, chart, artist, song)"""


def _anniversary_sql(ref: str, rank: int = 1, extra_where: str = "") -> str:
    body = f"""
select provider, chart, frequency, year, artist, song, date
from idx, (select dayofyear(ws) s, dayofyear(ws + 6) e, month(ref) rm, year(ref) ry,
             case when day(ref) <= 14 then 1 else 15 end fd
           from (select ref, ref - cast(dayofweek(ref) as integer) ws
                 from (select date '{ref}' as ref))) b
where this_week = {rank} and year <= ry {extra_where} and (
  (frequency = 'weekly' and case when s <= e then dayofyear(date) between s and e
                                 else dayofyear(date) >= s or dayofyear(date) <= e end)
  or (frequency = 'monthly' and month = rm)
  or (frequency = 'fortnightly' and month = rm and day = fd))"""
    return _with(body)


def _calendar_sql(year: int, extra_where: str = "") -> str:
    leap = f"({year} % 400 = 0 or ({year} % 4 = 0 and {year} % 100 <> 0))"
    body = f"""
select cast(weekofyear(date) as integer) as week, date, original_date,
  song || ' by ' || artist || ' reaches #1 on the ' || chart as event
from (
  select *, make_date({year}, month(original_date),
      case when month(original_date) = 2 and day(original_date) = 29 and not {leap}
           then 28 else day(original_date) end) as date
  from (select provider, chart, artist, song, min(date) as original_date
        from idx where this_week = 1 {extra_where} group by provider, chart, artist, song))"""
    return _with(body, snap=False)


def _search_rows_sql(where: str) -> str:
    return _with(f"select provider, chart, date, this_week, artist, song from idx where {where}")


def _dl(col: str, raw: str) -> str:
    return f"damerau_levenshtein({col}, {_norm_sql(repr(raw))}) <= 2"


_INDEX_COLS = (
    "provider, chart, frequency, date, this_week, artist, song, artist_norm, song_norm, year, month, day"
)


_FIELD_SEARCH_SQL = f"""
select q.query, idx.provider, idx.chart, idx.date, idx.this_week, idx.artist, idx.song
from (select distinct artist, song, provider, year, concat_ws('/', artist, song, provider, year) as query
      from (select case when p_partkey % 5 <> 0 then p_brand || 'x' end as artist,
              case when p_partkey % 5 <> 1 then substr(p_name, 1, 2) || substr(p_name, 4) end as song,
              case when p_partkey % 2 = 0 then 'asia' end as provider,
              case when p_partkey % 3 = 0 then 1997 end as year from part)) q
join idx on (q.artist is null or damerau_levenshtein(idx.artist_norm, {_norm_sql('q.artist')}) <= 2)
  and (q.song is null or damerau_levenshtein(idx.song_norm, {_norm_sql('q.song')}) <= 2)
  and (q.provider is null or idx.provider = q.provider) and (q.year is null or idx.year = q.year)"""

_TYPO_JOIN_SQL = """
select distinct q.query, n.name
from (select distinct
        case p_partkey % 3
          when 0 then substr(nm, 2, 1) || substr(nm, 1, 1) || substr(nm, 3)
          when 1 then substr(nm, 1, 2) || substr(nm, 4)
          else nm || 's' end as query
      from (select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9&]', '', 'g') nm from part)) q
join (select distinct song_norm as name from idx) n
  on damerau_levenshtein(q.query, n.name) <= 2"""

_QUESTIONS_SQL = """,
questions as (
  select distinct cast(o_orderdate as date) as ref_date, lower(replace(r_name, ' ', '-')) as provider,
    lower(replace(r_name, ' ', '-')) || case when o_orderkey % 2 = 0 then '-standard' else '-promo' end as chart
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey)"""


def oracle_sql() -> dict[str, str]:
    sql = _chart_oracles()
    if llm is not None:
        sql |= llm.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql


def _chart_oracles() -> dict[str, str]:
    return {
        "show_chart_date": _with(
            "select provider, chart, this_week, artist, song, date from idx where date = date '1997-03-01'"
        ),
        "show_chart_provider_chart": _with(
            "select provider, chart, this_week, artist, song, date from idx "
            "where date = date '1998-06-13' and provider = 'europe' and chart = 'europe-standard'"
        ),
        "peak_year_default": _with(
            "select * from best where best_rank <= 10 and year(best_date) = 1998", extra=_best_sql()
        ),
        "peak_year_rank5_chart": _with(
            "select * from best where best_rank <= 5 and year(best_date) = 1999",
            extra=_best_sql("chart = 'asia-promo'"),
        ),
        "anniversary_weekly": _anniversary_sql("1999-03-10"),
        "anniversary_wrapped": _anniversary_sql("1999-12-29"),
        "anniversary_monthly": _anniversary_sql("1998-07-20", extra_where="and chart = 'europe-economy'"),
        "anniversary_fortnight_h1": _anniversary_sql("1997-05-03"),
        "anniversary_fortnight_h2": _anniversary_sql("1997-05-20"),
        "anniversary_rank5_provider": _anniversary_sql(
            "1998-10-14", rank=5, extra_where="and provider = 'america'"
        ),
        "anniversary_today": _anniversary_sql("2024-01-07"),
        "calendar_leap": _calendar_sql(2024),
        "calendar_common": _calendar_sql(2023),
        "calendar_provider": _calendar_sql(2023, "and provider = 'asia'"),
        "index_columns": _with(f"select {_INDEX_COLS} from idx"),
        "normalize_names": _with(
            "select artist as name, artist_norm as name_norm from idx "
            "union select song, song_norm from idx"
        ),
        "search_rows_artist": _search_rows_sql(_dl("artist_norm", "Brand#13")),
        "search_rows_song": _search_rows_sql(_dl("song_norm", "smal ring")),
        "search_artist_and_song": _search_rows_sql(
            _dl("artist_norm", "The Brand#7 feat NATION_2") + " and " + _dl("song_norm", "red plate")
        ),
        "search_on_date": _search_rows_sql(
            _dl("artist_norm", "brand#2") + " and date = date '1997-03-01'"
        ),
        "search_best_all": _with("select * from best", extra=_best_sql(_dl("artist_norm", "Brand#21"))),
        "search_best_in_year": _with(
            "select * from best",
            extra=_best_sql(_dl("song_norm", "hot plate (live)") + " and year = 1998"),
        ),
        "search_transposed_query": _search_rows_sql(_dl("artist_norm", "Rbadn#11")),
        "search_filters_only": _search_rows_sql(
            "provider = 'africa' and chart = 'africa-large' and year = 1996"
        ),
        "peak_year_provider": _with(
            "select * from best where best_rank <= 3 and year(best_date) = 1997",
            extra=_best_sql("provider = 'middle-east'"),
        ),
        "calendar_chart": _calendar_sql(2025, "and chart = 'america-promo'"),
        "search_best_provider_chart": _with(
            "select * from best",
            extra=_best_sql(
                _dl("song_norm", "small widget") + " and provider = 'asia' and chart = 'asia-standard'"
            ),
        ),
        "search_song_in_year": _search_rows_sql(_dl("song_norm", "blue bolt") + " and year = 2000"),
        "anniversary_batch": _with(
            """
select ref_date, provider, chart, frequency, year, artist, song, date
from idx join (
  select ref_date, year(ref_date) ry, month(ref_date) rm,
    dayofyear(ref_date - cast(dayofweek(ref_date) as integer)) s,
    dayofyear(ref_date - cast(dayofweek(ref_date) as integer) + 6) e,
    case when day(ref_date) <= 14 then 1 else 15 end fd
  from (select distinct cast(o_orderdate as date) ref_date from orders)) b
on this_week = 1 and year <= ry and (
  (frequency = 'weekly' and case when s <= e then dayofyear(date) between s and e
                                 else dayofyear(date) >= s or dayofyear(date) <= e end)
  or (frequency = 'monthly' and month = rm)
  or (frequency = 'fortnightly' and month = rm and day = fd))"""
        ),
        "calendar_batch": _with(
            """
select target_year, cast(weekofyear(date) as integer) as week, date, original_date,
  song || ' by ' || artist || ' reaches #1 on the ' || chart as event
from (
  select *, make_date(target_year, month(original_date),
      case when month(original_date) = 2 and day(original_date) = 29
            and not (target_year % 400 = 0 or (target_year % 4 = 0 and target_year % 100 <> 0))
           then 28 else day(original_date) end) as date
  from (select provider, chart, artist, song, min(date) as original_date
        from idx where this_week = 1 and provider = 'europe'
        group by provider, chart, artist, song),
       (values (2023), (2024)) y(target_year))""",
            snap=False,
        ),
        "calendar_batch_years": _with(
            """
select target_year, cast(weekofyear(date) as integer) as week, date, original_date,
  song || ' by ' || artist || ' reaches #1 on the ' || chart as event
from (
  select *, make_date(target_year, month(original_date),
      case when month(original_date) = 2 and day(original_date) = 29
            and not (target_year % 400 = 0 or (target_year % 4 = 0 and target_year % 100 <> 0))
           then 28 else day(original_date) end) as date
  from (select provider, chart, artist, song, min(date) as original_date
        from idx where this_week = 1 group by provider, chart, artist, song),
       (select distinct cast(year(o_orderdate) as integer) as target_year from orders))""",
            snap=False,
        ),
        "search_batch_fields": _with(_FIELD_SEARCH_SQL),
        "fuzzy_join_words": """
select q.word as query, n.word as name
from (select distinct word from (select regexp_replace(strip_accents(w), '[^\\x00-\\x7f]', '', 'g') as word
        from (select distinct unnest(regexp_split_to_array(lower(text), '[\\x00-\\x60\\x7b-\\x7f]+')) as w from benchmark))
      where word <> '') q
join (select distinct word from (select regexp_replace(strip_accents(w), '[^\\x00-\\x7f]', '', 'g') as word
        from (select distinct unnest(regexp_split_to_array(lower(text), '[\\x00-\\x60\\x7b-\\x7f]+')) as w from documents))
      where word <> '') n
  on abs(length(q.word) - length(n.word)) <= 2 and damerau_levenshtein(q.word, n.word) <= 2""",
        "signature_name_join": _with(_TYPO_JOIN_SQL),
        "signature_refresh": _with(_TYPO_JOIN_SQL),
        "search_batch_stored": _with(_FIELD_SEARCH_SQL),
        "search_skipping": _search_rows_sql(
            _dl("artist_norm", "Brand#13 feat. NATION_5") + " and " + _dl("song_norm", "red plate")
        ),
        "index_refresh": _with(
            f"""
select provider, chart, frequency, date, this_week, artist, song, {_norm_sql('artist')} as artist_norm, song_norm,
  year, month, day
from (select * replace (case when chart = 'asia-economy' and year >= 1997 then artist || ' Band' else artist end as artist)
      from idx)
where not (chart = 'europe-promo' and year in (1996, 1997))"""
        ),
        "peaks_maintained": _with("select * from best", extra=_best_sql()),
        "peaks_maintained_year": _with(
            "select * from best where best_rank <= 10 and year(best_date) = 1998", extra=_best_sql()
        ),
        "covering_dates": _with(
            """
select q.ref_date, q.provider, q.chart, i.date
from questions q asof left join (select distinct provider, chart, date from idx) i
  on q.provider = i.provider and q.chart = i.chart and q.ref_date >= i.date""",
            extra=_QUESTIONS_SQL,
        ),
        "show_covering": _with(
            """
select c.ref_date, idx.provider, idx.chart, idx.this_week, idx.artist, idx.song, idx.date
from (select q.ref_date, q.provider, q.chart, i.date
      from questions q asof join (select distinct provider, chart, date from idx) i
        on q.provider = i.provider and q.chart = i.chart and q.ref_date >= i.date) c
join idx on idx.provider = c.provider and idx.chart = c.chart and idx.date = c.date
where idx.this_week <= 3""",
            extra=_QUESTIONS_SQL,
        ),
        "chart_history": _with(
            """
select provider, chart, date, this_week, artist, song, coalesce(last_week, 0) as last_week, peak_position,
  weeks_on_chart, run, weeks_in_run
from (
  select *, row_number() over (partition by provider, chart, artist, song, run order by place) as weeks_in_run
  from (
    select *, cast(sum(case when gap then 1 else 0 end) over own as bigint) as run,
      case when not gap then lag(this_week) over own end as last_week,
      min(this_week) over own as peak_position, row_number() over own as weeks_on_chart
    from (
      select *, coalesce(place - lag(place) over own, 2) <> 1 as gap
      from (select idx.*, place from idx join (
              select provider, chart, date, row_number() over (partition by provider, chart order by date) as place
              from (select distinct provider, chart, date from idx)) using (provider, chart, date))
      window own as (partition by provider, chart, artist, song order by place))
    window own as (partition by provider, chart, artist, song order by place)))"""
        ),
        "audit_index": _with(
            """
select provider, chart, date, 'missing date' as problem, 0::bigint as this_week, 0::bigint as entries
from (select provider, chart, unnest(case frequency
          when 'weekly' then generate_series(lo, hi, interval 7 days)
          when 'monthly' then generate_series(date_trunc('month', lo), hi, interval 1 month)
          else list_concat(generate_series(date_trunc('month', lo), hi, interval 1 month),
            list_transform(generate_series(date_trunc('month', lo), hi, interval 1 month), lambda x: x + interval 14 days))
          end)::date as date, lo, hi
      from (select provider, chart, frequency, min(date)::timestamp lo, max(date)::timestamp hi from kept group by all)) e
where date between lo and hi
  and not exists (select 1 from kept k where k.provider = e.provider and k.chart = e.chart and k.date = e.date)
union all
select s.provider, s.chart, s.date, 'missing rank', s.r, 0
from (select provider, chart, date, unnest(range(1, size + 1)) as r from sized) s
left join counts c on c.provider = s.provider and c.chart = s.chart and c.date = s.date and c.this_week = s.r
where c.n is null
union all
select provider, chart, date, 'repeated rank', this_week, n from counts where n > 1
union all
select c.provider, c.chart, c.date, 'over size', c.this_week, c.n
from counts c join sized s on c.provider = s.provider and c.chart = s.chart and c.date = s.date where c.this_week > size""",
            extra=""",
kept as (
  select * replace (case when this_week % 7 = 0 then this_week - 1 else this_week end as this_week)
  from idx where frequency <> 'weekly' or weekofyear(date) % 5 <> 0),
counts as (select provider, chart, date, this_week, count(*) as n from kept group by all),
sized as (
  select distinct provider, chart, date,
    case when date <= date '1996-06-30' then length(chart) % 5 + 3 else 12 end as size from kept)""",
        ),
        "best_rank_of_variants": _with(
            """
select provider, chart, artist, song, min(this_week) as best_rank, min(date) filter (where this_week = mn) as best_date
from (select *, min(this_week) over (partition by provider, chart, artist, song) as mn
      from (select provider, chart, date, this_week, artist_norm as artist, coalesce(least, song_norm) as song
            from idx left join canonical on song_norm = name))
group by provider, chart, artist, song""",
            extra=""",
names as (select distinct song_norm as name from idx where length(song_norm) >= 10),
links as (select a.name as a, b.name as b from names a join names b on damerau_levenshtein(a.name, b.name) <= 2),
canonical as (
  select a as name, min(b) as least
  from (with recursive reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
        select * from reach)
  group by a)""",
        ),
        "search_batch": _with(
            f"""
select q.query, provider, chart, date, this_week, artist, song
from (select distinct substr(p_brand, 1, 1) || substr(p_brand, 3, 1) || substr(p_brand, 2, 1)
        || substr(p_brand, 4) as query from part) q
join idx on damerau_levenshtein(idx.artist_norm, {_norm_sql('q.query')}) <= 2"""
        ),
        "fuzzy_join": _with(_TYPO_JOIN_SQL),
    }
