"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source's target is its weighted share of the words of all sources, at most
``max_epochs`` times its own size; what a capped source cannot take is shared
by weight among the others until none is above its cap.  A target of ``t``
words over a source of ``s`` words takes ``floor(t / s)`` complete epochs, then
a fraction: documents in ascending order of the exponential key
``-ln(u) / quality`` (a quality-weighted sample without replacement) as far as
the rest of the budget goes.  A few more passes in the same order fill what the
first document too large leaves open, and one last document closes the gap
where its size brings the source nearer to its target.

The order inside a source is a sort of narrow rows, cut into buckets of keys:
the buckets' sizes are prefix-summed, then each bucket is summed on its own,
so a source of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toplist.llm.common import packed, running_totals, stored, word_count

# Documents of one source ordered in one task (about; keys are spread evenly).
ROWS_PER_BUCKET = 10_000
# Fixed value: hexadecimal digits of the hash behind a document's uniform number (52 bits).
UNIFORM_DIGITS = 13
# Passes over the documents of a source: the sample itself, then what still fits its gap.
FILL_ROUNDS = 4


def letter_quality(text: Column) -> Column:
    """Sampling weight from 0.5 (no letters) to 1.5 (letters only); empty and null text: 0.5."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(n > 0, 0.5 + letters / n).otherwise(F.lit(0.5))


def uniform(key: Column, seed: str) -> Column:
    """A number inside (0, 1) that depends on the key and seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, UNIFORM_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**UNIFORM_DIGITS))


def cycled(weights: list[float]):
    """Weight by a source's place in code-point order, repeating the list."""
    return lambda place: F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")
    )


def source_targets(sources: DataFrame, weight_of, max_epochs: int = 3) -> DataFrame:
    """``source, source_size`` with ``place`` (code-point order, null last), ``weight`` and ``target``.

    The water level of the capped shares is found in closed form: with sources
    in order of ``cap / weight``, the level that remains after capping the
    first ``k`` rises while they are capped rightly and falls after, so the
    largest is the answer.
    """
    ranked = running_totals(
        sources.select("source", "source_size", F.col("source").isNull().alias("_none"), F.lit(1).alias("one")),
        ["_none", "source"],
        ["one"],
        "mix-sources",
    ).select("source", "source_size", F.col("before_one").alias("place"))
    capped = ranked.withColumns(
        {"weight": weight_of(F.col("place")), "cap": F.col("source_size") * F.lit(float(max_epochs))}
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    levels = running_totals(capped, ["ratio", "place"], ["cap", "weight"], "mix-levels")
    totals = levels.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = levels.join(F.broadcast(totals)).agg(  # one row
        F.max(
            (F.col("all_size") - F.col("before_cap")) / (F.col("all_weight") - F.col("before_weight"))
        ).alias("level")
    )
    return levels.join(F.broadcast(level)).select(  # one row
        "source", "source_size", "place", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: list[float],
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: int = 3,
    seed: str = "mix",
    quality: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Per document: ``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``, and ``carry``.

    ``size`` is the number of words (null text: 0) and ``taken`` is ``copies``
    times it.  Weights go round the sources in code-point order; documents
    without source are a source of their own, the last.  Sources without words
    have target 0.  Repeated rows are documents of their own, taken one after
    the other.  Carried columns named like an output are left out.  Without rows
    there is no result row.
    """
    text = F.col(text_col)
    own = {id_col, "source", "size", "source_size", "target", "copies", "taken"}
    carry = [c for c in (carry or []) if c not in own]
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(text).alias("size"),
            (-F.log(uniform(F.col(id_col), seed)) / (quality if quality is not None else letter_quality(text))).alias("key"),
            packed(docs, carry, "carried"),
        ),
        "mix-sizes",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sources, cycled(weights), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", F.least(whole, F.lit(max_epochs)).cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    # One row per source, stored so that the planner sees its size.
    targets = stored(
        targets.join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"),
        "mix-targets",
    )

    buckets = F.ceil(F.col("n") / ROWS_PER_BUCKET)
    state = (
        rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("bucket", F.least(F.floor(buckets * (1 - F.exp(-F.col("key")))), buckets - 1).cast("long"))
        .withColumns({"gap": F.col("rest"), "extra": F.lit(False)})
    )
    state = stored(state, "mix-placed")
    for number in range(FILL_ROUNDS):
        state = _filled(state, first=number == 0)

    off = F.abs(F.col("size") - F.col("gap"))
    closing = (
        state.where(~F.col("extra") & (F.col("size") > 0) & (off < F.col("gap")))
        .groupBy("place")
        .agg(F.min(F.struct(off.alias("off"), "key", "row")).alias("best"))
        .select("place", F.col("best.row").alias("closing"))
    )
    closed = state.join(stored(closing, "mix-closing"), "place", "left")
    extra = F.col("extra") | F.coalesce(F.col("row") == F.col("closing"), F.lit(False))
    copies = F.col("epochs") + F.when(extra, 1).otherwise(0)
    return closed.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *[F.col(f"carried.`{c}`") for c in carry],
    )


def _filled(state: DataFrame, first: bool) -> DataFrame:
    """``state`` after one more pass in key order: documents go in as far as each source's ``gap`` reaches.

    The first pass sums all documents and so takes the beginning of the order;
    later ones sum those that are left and no larger than the gap.
    """
    open_rows = ~F.col("extra") & (F.col("size") > 0)
    if not first:
        open_rows &= F.col("size") <= F.col("gap")
    state = state.withColumn("summed", F.when(open_rows, F.col("size")).otherwise(0))
    ahead = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        state.groupBy("place", "bucket")
        .agg(F.sum("summed").alias("bucket_size"))
        .select("place", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_start"))
    )
    inside = Window.partitionBy("place", "bucket").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    state = stored(
        state.withColumn("within", F.sum("summed").over(inside))
        .join(offsets, ["place", "bucket"])
        .withColumn(
            "added", (F.col("summed") > 0) & (F.col("bucket_start") + F.col("within") <= F.col("gap"))
        )
        .drop("within", "bucket_start"),
        "mix-pass",
    )
    used = state.groupBy("place").agg(F.sum(F.when(F.col("added"), F.col("size")).otherwise(0)).alias("used"))
    return stored(
        state.join(stored(used, "mix-used"), "place")
        .withColumns({"extra": F.col("extra") | F.col("added"), "gap": F.col("gap") - F.col("used")})
        .drop("used", "added", "summed"),
        "mix-filled",
    )
