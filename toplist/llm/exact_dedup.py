"""Exact duplicates by deterministic block naming.

1. The normalised text (white space deleted) is cut into blocks of
   ``block_bytes`` bytes.  The distinct blocks of the corpus are sorted and
   numbered: equal blocks get one integer name, different blocks different ones.
2. Adjacent names are paired, the distinct pairs are sorted and numbered in the
   same way, and so on until every document is left with one name.  A name of a
   level stands for exactly one sequence of blocks, so two documents end at the
   same level with the same name if and only if their texts are equal.

Block contents are shuffled once, distinct ones only.  A document finds the
names of its blocks by two 64-bit keys of the block; the table of distinct
blocks proves that no two of them share both keys, and if two ever do the
keys are drawn anew, so names never rest on a hash being lucky.

Names of a level are ``(partition, place in its sorted order)``, which Spark
numbers without gathering anything.  Blocks, pairs and groups that occur very
often are counted before they are shuffled and their rows are dealt to several
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toplist.llm.common import GAP_CHARS, stored

# Bytes of a block.
BLOCK_BYTES = 512
# Rows of one block, pair or group joined in one task (about).
ROWS_PER_SLICE = 2_000
# Often repeated keys looked up by broadcasting them (at most 40 bytes each); more are looked up by a shuffle join.
BROADCAST_KEYS = 100_000
# Fixed value: stands for the missing right half of an odd last pair (names are never negative).
NONE = -1
# Draws of the two block keys before the job gives up (one suffices unless the keys of two blocks collide).
DRAWS = 8


def without_gaps(text: Column) -> Column:
    """The text without space and ``\\t``-``\\r``; empty for null."""
    bare = F.coalesce(text.cast("string"), F.lit(""))
    for gap in GAP_CHARS:
        bare = F.replace(bare, F.lit(gap), F.lit(""))
    return bare


def _blocks(data: str, size: int) -> Column:
    """The ``size``-byte blocks of the binary column ``data``; one empty block for an empty one."""
    last = F.greatest(F.ceil(F.octet_length(data) / size).cast("int") - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(F.col(data), i * size + 1, F.lit(size))
    )


def _keys(block: Column, draw: int) -> Column:
    """The two 64-bit keys of a block."""
    return F.struct(F.xxhash64(F.lit(2 * draw), block).alias("a"), F.xxhash64(F.lit(2 * draw + 1), block).alias("b"))


def _named(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """``rows JOIN names`` on ``keys`` (unique in ``names``, where ``n`` counts their rows), hot keys dealt out."""
    hot = names.where(F.col("n") > ROWS_PER_SLICE).select(
        *keys, F.ceil(F.col("n") / ROWS_PER_SLICE).cast("int").alias("slices")
    )
    found = hot.count()
    if not found:
        return rows.join(names.drop("n"), keys)
    if found <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    dealt = rows.join(hot, keys, "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.col("slices")), F.lit(0))
    )
    slices = F.ceil(F.col("n") / ROWS_PER_SLICE).cast("int")
    spread = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), slices.cast("long") - 1))).drop("n")
    return dealt.drop("slices").join(spread, [*keys, "salt"]).drop("salt")


def _numbered(counted: DataFrame, keys: list[str], level: int) -> DataFrame:
    """The distinct ``keys`` (with ``n``) sorted and numbered: ``name``."""
    return stored(
        counted.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()),
        f"exact-names-{level}",
    )


def _first_names(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The documents with the keys of their blocks, and the names of all blocks by key."""
    bare = docs.withColumn("bare", without_gaps(F.col("text"))).withColumn("data", F.col("bare").cast("binary"))
    blocks = bare.select(F.explode(_blocks("data", size)).alias("block")).groupBy("block").agg(F.count("*").alias("n"))
    for draw in range(DRAWS):
        key = _keys(F.col("block"), draw)
        names = stored(
            blocks.sortWithinPartitions("block").select(
                key["a"].alias("a"), key["b"].alias("b"), "n", F.monotonically_increasing_id().alias("name")
            ),
            "exact-names-0",
        )
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            rows = bare.select(
                F.monotonically_increasing_id().alias("row"),
                "id",
                F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                F.sha2("data", 256).alias("text_sha256"),
                F.transform(_blocks("data", size), lambda b: _keys(b, draw)).alias("keys"),
            )
            return stored(rows, "exact-rows"), names
    raise RuntimeError(f"different blocks shared both keys in {DRAWS} draws")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(rows, names)`` for ``docs`` with columns ``id`` and ``text``.

    ``rows`` has a ``row`` number, ``id``, ``n_chars`` and ``text_sha256`` per
    document; ``names`` has its ``row`` and identity, ``level`` and ``name``.
    """
    rows, names = _first_names(docs, block_bytes)
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    places = rows.select("row", F.size("keys").alias("size"), F.posexplode("keys").alias("at", "key")).select(
        "row", "size", "at", "key.a", "key.b"
    )
    now = stored(_named(places, names, ["a", "b"]).select("row", "size", "at", "name"), "exact-level-0")
    level, done = 0, []
    while True:
        done.append(now.where("size = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        left, right = F.when(F.col("at") % 2 == 0, F.col("name")), F.when(F.col("at") % 2 == 1, F.col("name"))
        pairs = stored(
            now.where("size > 1")
            .groupBy("row", "size", F.floor(F.col("at") / 2).cast("int").alias("half"))
            .agg(F.max(left).alias("l"), F.coalesce(F.max(right), F.lit(NONE)).alias("r"))
            .select("row", F.ceil(F.col("size") / 2).cast("int").alias("size"), F.col("half").alias("at"), "l", "r"),
            f"exact-pairs-{level}",
        )
        level, longest = level + 1, -(-longest // 2)
        names = _numbered(pairs.groupBy("l", "r").agg(F.count("*").alias("n")), ["l", "r"], level)
        now = stored(_named(pairs, names, ["l", "r"]).select("row", "size", "at", "name"), f"exact-level-{level}")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return rows, found


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical after deleting space and
    ``\\t``-``\\r``; null counts as empty, and all empty texts are one group.
    Of equal texts the row with the most code points in its original text, then
    the smallest id stays; rows without id come after those with one, and of
    rows alike in all of this any one stays.  ``keep_id`` is the id of the row
    that stays (null if it has none), ``text_sha256`` the hash of the
    normalised text in UTF-8.  Other columns of ``docs`` are not read.
    """
    rows, names = identities(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), block_bytes)
    placed = stored(rows.drop("keys").join(names, "row"), "exact-placed")
    first = F.struct((-F.col("n_chars")).alias("chars"), F.col("id").isNull().alias("nameless"), "id", "row")
    groups = stored(
        placed.groupBy("level", "name")
        .agg(F.count("*").alias("n"), F.min(first).alias("first"))
        .select(
            "level", "name", "n", F.col("n").alias("group_size"),
            F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"),
        ),
        "exact-groups",
    )
    return _named(placed, groups, ["level", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
