"""Provider metadata -> catalog tables and Frictionless descriptors.

A data root holds one directory per provider with a ``*-metadata.json``
file (name, country, url, prefix and a list of charts) and one folder of
annual CSV files per chart.  Everything here is a DataFrame built from an
explicit-schema JSON read; descriptors are rendered with ``to_json``.

* :func:`read_metadata`      -- one row per provider directory
* :func:`chart_catalog`      -- one row per chart: provider dir, folder, tags
* :func:`list_charts`        -- ``provider, name, title, frequency, start_date, end_date``
* :func:`field_schema`       -- per chart, the Table Schema of its CSV fields
* :func:`package_descriptors`-- per provider, its data-package JSON
* :func:`master_catalog`     -- one row, the catalog JSON over all providers
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a chart entry is read as; every key of the document besides CHART_PARTS is kept in ``custom``.
CHART_FIELDS = {
    "name": "string",
    "folder": "string",
    "prefix": "string",
    "frequency": "string",
    "start_date": "string",
    "end_date": "string",
    "fields": "array<string>",
}
CHART_PARTS = ["name", "folder", "prefix", "fields"]
PROVIDER_META = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("charts", T.ArrayType(T.VariantType())),
    ]
)

# Frictionless field types by CSV column name (default "string").
FIELD_TYPES = {
    "date": "date",
    "this_week": "integer",
    "last_week": "integer",
    "two_weeks_ago": "integer",
    "peak_position": "integer",
    "weeks_on_chart": "integer",
    "artist": "string",
    "song": "string",
    "composer": "string",
    "country": "string",
}

# The master catalog header.
CATALOG_NAME = "international-music-charts-1980-1999"
CATALOG_TITLE = "International Music Charts Dataset (1980-1999)"
CATALOG_DESCRIPTION = "A collection of standardized music chart datasets from multiple providers."

def _path_part(path: Column, from_end: int) -> Column:
    """Path segment counted from the end (1 = file name)."""
    return F.element_at(F.split(path, "/"), -from_end)


def source_path() -> Column:
    """The input file of each row, decoded (``_metadata.file_path`` is a URI:
    a space arrives as ``%20``).  A literal ``+`` is protected from the
    form-decoding rule that would turn it into a space."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """One row per provider directory holding a ``*-metadata.json``.

    Directories without one are skipped; when a directory holds several,
    the first by path wins.  Adds ``provider`` (the directory name).  ``charts``
    are structs of :data:`CHART_FIELDS` and ``custom``, a map of the document's
    other keys with their values as they are.
    """
    root = root.rstrip("/")
    raw = (
        spark.read.option("multiLine", True)
        .option("mode", "FAILFAST")
        .schema(PROVIDER_META)
        .json(f"{root}/*/*-metadata.json")
        .select("*", source_path().alias("_path"))
        .withColumn("provider", _path_part(F.col("_path"), 2))
    )
    first = raw.groupBy("provider").agg(F.min("_path").alias("_path"))
    kept = raw.join(first, ["provider", "_path"], "left_semi").drop("_path")
    return kept.withColumn("charts", F.transform("charts", _chart))


def _chart(c: Column) -> Column:
    known = [F.variant_get(c, "$." + name, kind).alias(name) for name, kind in CHART_FIELDS.items()]
    keys = F.map_filter(c.cast("map<string,variant>"), lambda k, _: ~k.isin(CHART_PARTS))
    return F.struct(*known, keys.alias("custom"))


def root_path(spark: SparkSession, root: str) -> str:
    """The path part of the data root, fully qualified by its file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toUri().getPath().rstrip("/")


def below_root(path: Column, root: str) -> Column:
    """A file's path relative to the root (as :func:`root_path` gives it)."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substr(bare, F.lit(len(root) + 2))


def clean_path(path: Column) -> Column:
    """A relative path without empty and ``.`` segments (``a//b/./`` is ``a/b``)."""
    return F.array_join(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), "/")


def chart_catalog(metadata: DataFrame) -> DataFrame:
    """One row per chart: ``provider`` (directory), provider metadata and the chart struct."""
    return metadata.select(
        "provider",
        F.col("name").alias("provider_name"),
        F.col("prefix").alias("provider_prefix"),
        "country",
        "url",
        F.posexplode("charts").alias("chart_pos", "chart"),
    )


def list_charts(spark: SparkSession, root: str, descriptors: str | None = None) -> DataFrame:
    """All charts: ``provider, name, title, frequency, start_date, end_date``.

    Read from the written master catalog where the tree has one, and from the
    providers' metadata otherwise.
    """
    written = find_catalog(spark, root, descriptors)
    if written is not None:
        return list_charts_from_catalog(spark, written)
    charts = chart_catalog(read_metadata(spark, root))
    return charts.select(
        "provider",
        F.col("chart.prefix").alias("name"),
        F.col("chart.name").alias("title"),
        F.col("chart.frequency").alias("frequency"),
        F.col("chart.start_date").alias("start_date"),
        F.col("chart.end_date").alias("end_date"),
    ).orderBy("provider", "name")


def field_type(name: Column) -> Column:
    """Frictionless type of a CSV column name, ``string`` when unknown."""
    pairs = [F.lit(x) for kv in FIELD_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit("string"))


def table_schema(fields: Column) -> Column:
    """``{"fields": [{"name", "type"}, ...]}`` for an array of column names."""
    return F.struct(
        F.transform(
            fields, lambda f: F.struct(f.alias("name"), field_type(f).alias("type"))
        ).alias("fields")
    )


def field_schema(spark: SparkSession, root: str) -> DataFrame:
    """One row per chart field: ``provider, chart, position, name, type``."""
    charts = chart_catalog(read_metadata(spark, root))
    return charts.select(
        "provider",
        F.col("chart.prefix").alias("chart"),
        F.posexplode("chart.fields").alias("position", "name"),
    ).withColumn("type", field_type(F.col("name")))


def csv_files(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.csv`` below a provider's folder: ``provider, folder, file``.

    ``folder`` and ``file`` are relative to the provider; folders may be nested.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .load(root.rstrip("/"))
        .select(F.split(below_root(F.col("path"), root_path(spark, root)), "/").alias("parts"))
        .where(F.size("parts") > 1)
    )
    n = F.size("parts")
    return listing.select(
        F.col("parts")[0].alias("provider"),
        F.array_join(F.slice("parts", F.lit(2), n - 2), "/").alias("folder"),
        F.array_join(F.slice("parts", F.lit(2), n - 1), "/").alias("file"),
    )


def charts_with_files(spark: SparkSession, root: str, charts: DataFrame) -> DataFrame:
    """``charts`` with ``paths``: the sorted CSV files of the chart's folder (none: an empty list)."""
    files = csv_files(spark, root).groupBy("provider", "folder").agg(
        F.sort_array(F.collect_list("file")).alias("paths")
    )
    charts = charts.withColumn("folder", clean_path(F.col("chart.folder")))
    joined = charts.join(files, ["provider", "folder"], "left")
    return joined.withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def _resources(spark: SparkSession, root: str, charts: DataFrame) -> DataFrame:
    """Per chart: its data-resource struct (with the sorted CSV path list)."""
    with_files = charts_with_files(spark, root, charts)
    return with_files.select(
        "provider",
        "chart_pos",
        F.struct(
            F.lit("tabular-data-resource").alias("profile"),
            F.col("chart.prefix").alias("name"),
            F.col("chart.name").alias("title"),
            F.col("paths").alias("path"),
            F.lit("csv").alias("format"),
            F.lit("text/csv").alias("mediatype"),
            F.struct(F.lit(",").alias("delimiter")).alias("dialect"),
            table_schema(F.col("chart.fields")).alias("schema"),
            F.col("chart.custom").alias("custom"),
        ).alias("resource"),
    )


def package_descriptors(spark: SparkSession, root: str) -> DataFrame:
    """Per provider directory: ``provider, descriptor`` (data-package JSON text).

    ``country``/``url`` are omitted when empty (``to_json`` drops nulls).
    """
    metadata = read_metadata(spark, root)
    resources = _resources(spark, root, chart_catalog(metadata))
    gathered = resources.groupBy("provider").agg(
        F.array_sort(
            F.collect_list(F.struct("chart_pos", "resource")),
            lambda x, y: x["chart_pos"] - y["chart_pos"],
        ).alias("res")
    )
    pkg = metadata.join(gathered, "provider", "left").select(
        "provider",
        F.struct(
            F.lit("tabular-data-package").alias("profile"),
            F.col("prefix").alias("name"),
            F.concat(F.col("name"), F.lit(" Charts Dataset")).alias("title"),
            F.coalesce(F.transform("res", lambda r: r["resource"]), F.array()).alias("resources"),
            F.nullif(F.col("country"), F.lit("")).alias("country"),
            F.nullif(F.col("url"), F.lit("")).alias("url"),
        ).alias("descriptor"),
    )
    return pkg.select("provider", F.to_json("descriptor").alias("descriptor"))


def catalog_resources(metadata: DataFrame) -> DataFrame:
    """Per provider: the master-catalog data-resource struct."""
    charts = F.transform(
        F.col("charts"),
        lambda c: F.struct(
            c["prefix"].alias("name"),
            c["name"].alias("title"),
            c["frequency"].alias("frequency"),
            c["start_date"].alias("start_date"),
            c["end_date"].alias("end_date"),
        ),
    )
    return metadata.select(
        "provider",
        F.struct(
            F.lit("data-resource").alias("profile"),
            F.col("provider").alias("name"),
            F.concat(F.col("provider"), F.lit("/datapackage.json")).alias("path"),
            F.lit("json").alias("format"),
            F.lit("application/json").alias("mediatype"),
            F.col("name").alias("title"),
            F.struct(F.col("country").alias("country"), charts.alias("charts")).alias("custom"),
        ).alias("resource"),
    )


def master_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row: ``catalog`` (JSON text) listing every provider, in directory order."""
    res = catalog_resources(read_metadata(spark, root))
    one = res.agg(F.sort_array(F.collect_list(F.struct("provider", "resource"))).alias("res"))
    return one.select(
        F.to_json(
            F.struct(
                F.lit("data-package").alias("profile"),
                F.lit(CATALOG_NAME).alias("name"),
                F.lit(CATALOG_TITLE).alias("title"),
                F.lit(CATALOG_DESCRIPTION).alias("description"),
                F.transform("res", lambda r: r["resource"]).alias("resources"),
            )
        ).alias("catalog")
    )


# Schemas of the descriptors as read back (only the fields the engine uses are
# declared; `custom` is reached by nested path).
CATALOG_READ = T.StructType(
    [
        T.StructField(
            "resources",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("path", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField(
                            "custom",
                            T.StructType(
                                [
                                    T.StructField("country", T.StringType()),
                                    T.StructField(
                                        "charts",
                                        T.ArrayType(
                                            T.StructType(
                                                [
                                                    T.StructField("name", T.StringType()),
                                                    T.StructField("title", T.StringType()),
                                                    T.StructField("frequency", T.StringType()),
                                                    T.StructField("start_date", T.StringType()),
                                                    T.StructField("end_date", T.StringType()),
                                                ]
                                            )
                                        ),
                                    ),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)
PACKAGE_READ = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField(
            "resources",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("path", T.VariantType()),
                        T.StructField(
                            "schema",
                            T.StructType(
                                [
                                    T.StructField(
                                        "fields",
                                        T.ArrayType(T.StructType([T.StructField("name", T.StringType())])),
                                    )
                                ]
                            ),
                        ),
                        T.StructField(
                            "custom", T.StructType([T.StructField("frequency", T.StringType())])
                        ),
                    ]
                )
            ),
        ),
    ]
)


def _required(c: Column, what: str) -> Column:
    """``c`` itself, failing the query on a null (checked wherever ``c`` is used)."""
    msg = F.lit(f"catalog validation failed: {what} is required")
    return F.when(c.isNotNull(), c).otherwise(F.raise_error(msg))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Validated master catalog -> one row per provider: ``provider, path, charts``.

    A malformed document fails the read (``FAILFAST``); a provider without
    ``name``, ``path`` or ``custom.charts`` fails the query that uses it.
    """
    doc = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(CATALOG_READ).json(path)
    res = doc.select(F.explode(_required(F.col("resources"), "resources")).alias("r"))
    return res.select(
        _required(F.col("r.name"), "resources[].name").alias("provider"),
        _required(F.col("r.path"), "resources[].path").alias("path"),
        _required(F.col("r.custom.charts"), "resources[].custom.charts").alias("charts"),
    )


def list_charts_from_catalog(spark: SparkSession, path: str) -> DataFrame:
    """:func:`list_charts` read from a written master catalog."""
    cat = read_catalog(spark, path)
    return cat.select("provider", F.inline("charts")).select(
        "provider", "name", "title", "frequency", "start_date", "end_date"
    ).orderBy("provider", "name")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Validated provider packages -> one row per chart resource.

    ``provider, package, chart, frequency, paths, fields``; ``provider`` is the
    package's folder, ``paths`` a list whether the document has a list or one
    string, and ``frequency``, read by nested path from ``custom.frequency``, is
    required.
    """
    doc = (
        spark.read.option("multiLine", True)
        .option("mode", "FAILFAST")
        .schema(PACKAGE_READ)
        .json(path)
        .select("*", source_path().alias("_path"))
    )
    res = doc.select(
        F.regexp_replace(_path_part(F.col("_path"), 2), "^provider=", "").alias("provider"),
        F.col("name").alias("package"),
        F.explode(_required(F.col("resources"), "resources")).alias("r"),
    )
    one = F.try_variant_get(F.col("r.path"), "$", "string")
    return res.select(
        "provider",
        "package",
        _required(F.col("r.name"), "resources[].name").alias("chart"),
        _required(F.col("r.custom.frequency"), "resources[].custom.frequency").alias("frequency"),
        F.coalesce(F.try_variant_get(F.col("r.path"), "$", "array<string>"), F.array(one)).alias("paths"),
        F.col("r.schema.fields.name").alias("fields"),
    )


def _is_there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def find_catalog(spark: SparkSession, root: str, descriptors: str | None = None) -> str | None:
    """Where the written master catalog is: the descriptors' folder or the root itself; ``None`` without one."""
    root = root.rstrip("/")
    places = [f"{(descriptors or root + '/descriptors').rstrip('/')}/catalog", f"{root}/datapackage.json"]
    return next((p for p in places if _is_there(spark, p)), None)


def read_described_charts(spark: SparkSession, root: str, descriptors: str | None = None) -> DataFrame:
    """The charts of the catalog's providers as their package descriptors have them (:func:`read_packages`).

    Packages are the generated ones beside the catalog, or ``datapackage.json``
    in the providers' folders; only providers of the catalog count.
    """
    root = root.rstrip("/")
    catalog = find_catalog(spark, root, descriptors)
    if catalog is None:
        raise ValueError(f"no catalog under {descriptors or root}")
    beside = catalog.rsplit("/", 1)[0] + "/packages"
    where = f"{beside}/provider=*" if catalog.endswith("/catalog") else f"{root}/*/datapackage.json"
    providers = read_catalog(spark, catalog).select("provider")
    return read_packages(spark, where).join(providers, "provider", "left_semi")


def generate_frictionless_packages(spark: SparkSession, root: str, out: str | None = None) -> None:
    """Write descriptors under ``out`` (default ``<root>/descriptors``):
    ``packages/provider=<dir>/`` and ``catalog/``.

    Text output, one JSON document per line (Spark writes directories of
    part files, so files are not placed inside the data tree).
    """
    out = out or f"{root.rstrip('/')}/descriptors"
    # Static overwrite whatever the session says: packages of providers that are gone go too.
    package_descriptors(spark, root).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("provider").text(f"{out.rstrip('/')}/packages")
    master_catalog(spark, root).coalesce(1).write.mode("overwrite").text(
        f"{out.rstrip('/')}/catalog"
    )
