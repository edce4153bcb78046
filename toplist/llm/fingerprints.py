"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is its words weighted by their counts.  For every sample ``k`` a
term of weight ``w`` draws, from hashes of the term and ``k`` alone,
``r ~ Gamma(2, 1)``, ``c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)``, and with
``t = floor(ln w / r + b)`` and ``ln a = ln c - r * (t - b + 1)`` the term of the
smallest ``a`` is the sample, as the pair (term, t).  Two documents agree on a
sample with the probability of their generalised Jaccard similarity
(sum of the smaller over sum of the larger weights), so the share of equal
samples of two fingerprints estimates it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toplist.llm.common import running_totals, stored, words

# Samples of a fingerprint and bits kept of each (a chance agreement: 1 in 2**24).
SAMPLES = 32
BITS = 24
# ln(a) lies between -SHIFT and 127 - SHIFT; its fixed-point steps of one.
SHIFT = 64
STEPS = 2**31


def _sample(term: str, log_weight: str, k: int) -> Column:
    """One sample's order and name in a long: ``ln a`` above, a hash of (term, t) below."""
    h = F.xxhash64(term, F.lit(k))
    more = F.xxhash64(h, F.lit(k))

    def part(x: Column, shift: int, bits: int) -> Column:
        return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(2**bits - 1)) + F.lit(0.5)

    r = -F.log(part(h, 0, 20) * part(h, 20, 20) * F.lit(2.0**-40))
    b = part(h, 40, 24) * F.lit(2.0**-24)
    c = -F.log(part(more, 0, 32) * part(more, 32, 32) * F.lit(2.0**-64))
    t = F.floor(F.col(log_weight) / r + b)
    place = F.floor((F.log(c) - r * (t - b + 1) + F.lit(float(SHIFT))) * F.lit(float(STEPS)))
    name = F.xxhash64(h, t).bitwiseAND(F.lit(2**BITS - 1))
    return F.shiftleft(place, BITS).bitwiseOR(name)


def signatures(
    texts: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES, copies: str | None = None
) -> DataFrame:
    """``keys`` and ``samples``: an array of one number per sample, for every row's text.

    ``keys`` name a row; where rows repeat, the column ``copies`` (one of the
    keys) tells how often.  A text without words has the samples of one
    nameless term, so such texts agree with each other and with no others.
    """
    weight = F.count("*") / (F.col(copies) if copies else F.lit(1.0))
    terms = (
        texts.select(*keys, F.explode_outer(words(F.col(text_col))).alias("word"))
        .groupBy(*keys, F.xxhash64("word").alias("term"))
        .agg(F.log(weight).alias("log_weight"))
    )
    drawn = terms.groupBy(*keys).agg(*[F.min(_sample("term", "log_weight", k)).alias(f"s{k}") for k in range(samples)])
    names = [F.col(f"s{k}").bitwiseAND(F.lit(2**BITS - 1)).cast("int") for k in range(samples)]
    return drawn.select(*keys, F.array(*names).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return same / F.size(a)


def fingerprint_text(samples: Column) -> Column:
    """A signature as lower-case hexadecimal digits."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per document: ``id_col`` and ``fingerprint``; null text counts as empty; equal texts agree."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "fingerprint-rows")
    found = signatures(rows, ["row", "id"], "text", samples)
    return found.select(F.col("id").alias(id_col), fingerprint_text(F.col("samples")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Every text's fingerprint beside that of an edit of it, and of the document after it.

    The edit replaces the last third of a text (in code points) by as many
    code points of the next document's beginning, or all it has.  Documents
    follow each other in descending ``id_col`` (null last; equal ids by text);
    the first comes after the last.  Rows that repeat id and text are one
    document with one result row; null text counts as empty.

    Only narrow rows are sorted.  Texts are dealt once by a key of their own;
    the third of them that edits need is sent to the documents it edits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text)))
    rows = docs.select(key.alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    narrow = (
        rows.groupBy("key", "id", F.length("text").cast("long").alias("n_chars"))
        .agg(F.count("*").alias("copies"))
        .withColumn("one", F.lit(1))
    )
    places = stored(running_totals(narrow, ["id", "key"], ["one"], "fingerprint-order"), "fingerprint-places")
    total = places.agg(F.count("*").alias("total"))
    # In descending order the next document is the one a place below; below the last place is the first.
    after = (
        places.join(F.broadcast(total))  # one row
        .withColumn("next_place", F.pmod(F.col("before_one") - 1, F.col("total")))
        .select(F.col("key").alias("to_key"), F.col("copies").alias("to_copies"), "next_place", F.floor(F.col("n_chars") / 3).cast("int").alias("third"))
    )
    links = stored(
        places.select("key", "copies", F.col("before_one").alias("next_place")).join(after, "next_place").drop("next_place"),
        "fingerprint-links",
    )
    texts = rows.select("key", "text")
    heads = texts.join(links, "key").select(
        F.col("to_key").alias("key"),
        F.col("to_copies").alias("copies"),
        F.substring("text", F.lit(1), F.col("third")).alias("head"),
    )
    n = F.length("text")
    pairs = texts.join(heads.dropDuplicates(["key"]), "key").select(
        "key", "copies", "text", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), "head").alias("edited")
    )
    both = pairs.select(
        "key",
        "copies",
        F.explode(
            F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))
        ).alias("x"),
    ).select("key", "copies", "x.which", "x.text")
    drawn = signatures(both, ["key", "copies", "which"], "text", samples, "copies")
    # One job for both, so that the texts are dealt once.
    hashes = pairs.select("key", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    signed = stored(
        drawn.groupBy("key")
        .agg(
            F.max(F.when(F.col("which") == 0, F.col("samples"))).alias("own"),
            F.max(F.when(F.col("which") == 1, F.col("samples"))).alias("edit"),
        )
        .join(hashes.dropDuplicates(["key"]), "key"),
        "fingerprint-signatures",
    )
    following = signed.join(links, "key").select(F.col("to_key").alias("key"), F.col("own").alias("next"))
    return (
        places.select("key", "id", "n_chars")
        .join(signed, "key")
        .join(following, "key")
        .select(
            F.col("id").alias(id_col),
            "n_chars",
            "edited_sha256",
            fingerprint_text(F.col("own")).alias("fingerprint"),
            fingerprint_text(F.col("edit")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("edit")).alias("near_edited"),
            likeness(F.col("own"), F.col("next")).alias("near_next"),
        )
    )
