"""Near-duplicate documents by bottom-k sketches of word-shingle sets.

1. One hash function; the ``sketch_size`` smallest shingle hashes of a document
   are its bottom-k sketch.  The sketch of a set of no more shingles is the set
   itself, so that all bounds on it are exact.  Documents with equal sets become
   one node, so copies cost nothing further.
2. Inverted lists of retained values generate the overlaps.  Two sets at the
   threshold must share at least ``o`` retained values, so only the rarest
   ``size - o + l`` values of a document are listed: a pair that shares ``o``
   values always shares ``l`` listed ones, while a document's many values shared
   with boilerplate never enter a list unless they make up most of it.  Pairs
   that share fewer than ``l`` listed values, by chance meetings of a phrase,
   go no further.  For pairs of sets held whole ``o`` follows from the two set
   sizes; for pairs with a larger set ``o`` is the bound that a pair at the
   threshold misses with a chance below ``MISS`` (a binomial tail).
3. The sketch of a candidate pair's union estimates its Jaccard similarity and
   filters; the survivors are confirmed on their full shingle sets.
4. Links only matter through components, so lists are not expanded into pairs:
   first each node is tried against the most central node of a list (the one
   with the fewest values of its own), then only pairs of a list that still lie
   in different components (members outside the list's largest component
   against the others) and whose ranks in the list allow as many shared values
   as linked sets of their sizes have.  Each such pair comes out of one list
   only.  Every pair that could join two components is tried; none is capped or
   sampled.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toplist.llm.common import salted, spread, stored
from toplist.llm.components import components
from toplist.llm.shingles import set_mapper

# Chance, per linked pair of long documents, that its sketches share fewer values than asked.
MISS = 1e-6
# Listed values that a pair must share (the ``l`` of step 2; fewer where its sets need to share fewer in all).
SHARED = 3
# Rows of a hot key joined in one task.
ROWS_PER_SLICE = 256
# Fixed value: marks list values of sketches, apart from those of whole sets.
SKETCH_MARK = 0x5851F42D4C957F2D
# Documents or sets looked up by broadcasting their keys (8 bytes each); more are looked up by a shuffle join.
BROADCAST_KEYS = 1_000_000


def shared_at_least(sketch_size: int, percent: int, miss: float = MISS) -> int:
    """Largest ``o`` with P(Binomial(sketch_size, percent %) < o) <= miss."""
    p, below, o = percent / 100, 0.0, 0
    while True:
        below += comb(sketch_size, o) * p**o * (1 - p) ** (sketch_size - o)
        if below > miss:
            return o
        o += 1


class _Job:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int,
                 sketch_size: int, whole_size: int):
        text = F.col(text_col)
        self.words, self.percent, self.sketch_size, self.whole_size = words, percent, sketch_size, whole_size
        self.docs = docs.select(
            F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"), text.cast("binary").alias("_text")
        )
        self.id_type = docs.schema[id_col].dataType.simpleString()
        # The sketches of equal sets are dropped before anything is written.
        self.nodes = stored(
            self.docs.select("_key", "_text")
            .mapInArrow(
                set_mapper(words, whole_size, sketch_size, ["_key"]),
                "_key long, set_hash binary, n_shingles long, shingles array<long>",
            )
            .where("n_shingles > 0")
            .dropDuplicates(["set_hash"])
            .withColumn("node", F.monotonically_increasing_id()),
            "minhash-nodes",
        )

    def rows(self) -> DataFrame:
        """``_id, set_hash, n_shingles`` of every document: a second pass, which needs less room than kept sketches."""
        return self.docs.select("_id", "_text").mapInArrow(
            set_mapper(self.words, 0, 0, ["_id"]),
            f"_id {self.id_type}, set_hash binary, n_shingles long, shingles array<long>",
        ).drop("shingles")

    def lists(self) -> DataFrame:
        """``value, node, n, sketched, rank, alone``: the listed (rarest) values of every node.

        ``rank`` counts a node's values from the rarest on; the first ``alone``
        of them no other node has.
        """
        n, k = F.col("n_shingles"), self.sketch_size
        # A set this large can be linked to one that is not held whole.
        sketched = n * 100 >= self.percent * self.whole_size
        own = F.when(n <= self.whole_size, F.col("shingles")).otherwise(F.array().cast("array<long>"))
        part = F.when(sketched, F.slice("shingles", 1, k)).otherwise(F.array().cast("array<long>"))
        marked = F.transform(part, lambda x: x.bitwiseXOR(F.lit(SKETCH_MARK)))
        # Only two longs of a value go through the large shuffles; the rest is looked up for the few that remain.
        values = self.nodes.select(
            "node", F.size(own).alias("whole"), F.posexplode(F.concat(own, marked)).alias("at", "value")
        ).select("node", "value", (F.col("at") >= F.col("whole")).alias("sketched"))
        often = values.groupBy("value").count().where(F.col("count") > 1)
        per_node = Window.partitionBy("node", "sketched")
        sizes = self.nodes.select("node", n.alias("n"))
        kept = F.when(F.col("sketched"), F.least(F.col("n"), F.lit(k))).otherwise(F.col("n"))
        ranked = (
            values.join(often, "value")
            .join(sizes, "node")
            .withColumn("size", kept)
            .withColumns(
                {
                    "alone": F.col("size") - F.count("*").over(per_node),
                    "place": F.row_number().over(per_node.orderBy("count", "value")),
                }
            )
            .withColumn("rank", F.col("alone") + F.col("place"))
        )
        asked = F.when(F.col("sketched"), F.lit(shared_at_least(k, self.percent))).otherwise(self._needed(F.col("n")))
        held = F.when(F.col("sketched"), F.lit(k)).otherwise(F.col("n"))
        listed = held - asked + F.least(asked, F.lit(SHARED))
        return stored(
            ranked.where(F.col("rank") <= listed).select("value", "node", "n", "sketched", "rank", "alone"),
            "minhash-lists",
        )

    def _share(self, part: Column, of: int) -> Column:
        """``part / of`` rounded up, in whole numbers."""
        return F.floor((part + (of - 1)) / of).cast("long")

    def _needed(self, n: Column) -> Column:
        """Shingles that a set of ``n`` shares at least with any set it is linked to."""
        return self._share(n * self.percent, 100)

    def _sketches_share(self, nx: Column, ny: Column) -> Column:
        """Retained values that the sketches of two linked sets of these sizes share, but for a chance of ``MISS``.

        The shingles they share are at least this percentage of the larger set,
        and the sketches share those among the first ``k`` of either set,
        whichever ends first: hence half the chance for each.
        """
        most = 200 * self.percent // (100 + self.percent)
        asked = [shared_at_least(self.sketch_size, p, MISS / 2) for p in range(self.percent, most + 1)]
        part = F.floor(100 * self.percent * (nx + ny) / ((100 + self.percent) * F.greatest(nx, ny)))
        at = F.least(F.greatest(part, F.lit(self.percent)), F.lit(most)) - self.percent + 1
        return F.element_at(F.array(*[F.lit(o) for o in asked]), at.cast("int"))

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose union sketch allows the threshold; ``sure`` where both sets were held whole."""
        held = self.nodes.select("node", "n_shingles", "shingles")
        # The sets are wide: only those of the pairs are shuffled, and each pair's once.
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if wanted.count() <= BROADCAST_KEYS:
            held = held.join(F.broadcast(wanted), "node", "left_semi")
        side = lambda x: held.select(
            F.col("node").alias(x), F.col("n_shingles").alias("n" + x), F.col("shingles").alias("s" + x)
        )
        both = self._both(pairs, side)
        k, o = self.sketch_size, shared_at_least(self.sketch_size, self.percent)
        sure = (F.col("na") <= self.whole_size) & (F.col("nb") <= self.whole_size)
        shared = F.size(F.array_intersect("sa", "sb"))
        exact = 100 * shared >= self.percent * (F.col("na") + F.col("nb") - shared)
        a, b = F.slice("sa", 1, k), F.slice("sb", 1, k)
        union = F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)
        likely = F.size(F.array_intersect(F.array_intersect(a, b), union)) >= o
        return both.where(F.when(sure, exact).otherwise(likely)).select("a", "b", sure.alias("sure"))

    def _both(self, pairs: DataFrame, side: Callable[[str], DataFrame]) -> DataFrame:
        """The pairs with the columns of both sides; they are dealt out before they carry any."""
        dealt, slices = salted(pairs, "a", ROWS_PER_SLICE)
        return dealt.join(side("b"), "b").join(spread(side("a"), slices, "a"), ["a", "_salt"]).drop("_salt")

    def sets(self, pairs: DataFrame) -> DataFrame:
        """``node, full``: the whole shingle sets of the nodes in the pairs, read from their texts again."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = stored(
            wanted.join(self.nodes.select("node", "set_hash", "_key"), "node"), "minhash-wanted"
        )
        keys = wanted.select("_key").distinct()
        if wanted.count() <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        full = (
            self.docs.join(keys, "_key", "left_semi")
            .dropDuplicates(["_key", "_text"])
            .select("_text")
            .mapInArrow(
                set_mapper(self.words, None, 0, []), "set_hash binary, n_shingles long, shingles array<long>"
            )
        )
        found = full.join(wanted.select("node", "set_hash"), "set_hash").dropDuplicates(["node"])
        return stored(found.select("node", F.col("shingles").alias("full")), "minhash-sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs at or over the threshold on their full sets."""
        pairs = stored(self.estimated(pairs), "minhash-pairs")
        open_pairs = pairs.where("not sure").select("a", "b")
        sets = self.sets(open_pairs)
        side = lambda x: sets.select(F.col("node").alias(x), F.col("full").alias("f" + x))
        both = self._both(open_pairs, side)
        shared = F.size(F.array_intersect("fa", "fb"))
        union = F.size("fa") + F.size("fb") - shared
        confirmed = both.where(100 * shared >= self.percent * union).select("a", "b")
        return stored(pairs.where("sure").select("a", "b").union(confirmed), "minhash-links")

    def first_pairs(self, lists: DataFrame) -> DataFrame:
        """One pair per node: with the most central node of the lists it shares most of."""
        first = (
            lists.groupBy("value")
            .agg(F.min_by("node", "alone").alias("first"), F.count("*").alias("k"))
            .where("k > 1")
            .drop("k")
        )
        overlaps = lists.join(first, "value").where("node <> first").groupBy("node", "first").count()
        best = overlaps.groupBy("node").agg(F.max(F.struct("count", "first")).alias("best"))
        pairs = best.select(F.least("node", "best.first").alias("a"), F.greatest("node", "best.first").alias("b"))
        return pairs.distinct()

    def meetings(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs ``a, b`` of a list that lie in different components and whose sizes and ranks allow a link.

        A pair that shares a passage shares many lists; it comes out once, at
        the last of the listed values it has to share: each member knows which
        values of its own are ahead, and all that allows a pair at one of its
        lists allows it at those ahead.
        """
        members = stored(
            lists.drop("alone").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")),
            "minhash-members",
        )
        largest = (
            members.groupBy("value", "label")
            .count()
            .groupBy("value")
            .agg(F.max_by("label", "count").alias("largest"), F.count("*").alias("labels"))
            .where("labels > 1")
            .select("value", "largest")
        )
        ahead = Window.partitionBy("node", "sketched").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        mixed = stored(
            members.join(largest, "value").withColumn("ahead", F.collect_list("value").over(ahead)), "minhash-mixed"
        )
        x = mixed.where("label <> largest").select(
            "value", "sketched", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"),
            F.col("rank").alias("rx"), F.col("ahead").alias("ax"),
        )
        y = mixed.select(
            "value", "largest", F.col("node").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"),
            F.col("rank").alias("ry"), F.col("ahead").alias("ay"),
        )
        # Whole sets of these sizes share this many shingles at the threshold, the first in both lists included.
        asked = self._share((F.col("nx") + F.col("ny")) * self.percent, 100 + self.percent)
        # They share SHARED listed values, so each of the first of them has as many others behind it, less those before.
        slack = F.lit(SHARED)
        whole = (F.col("rx") + asked <= F.col("nx") + slack) & (F.col("ry") + asked <= F.col("ny") + slack)
        held = lambda n: F.least(n, F.lit(self.sketch_size)) + slack
        retained = self._sketches_share(F.col("nx"), F.col("ny"))
        sketches = (
            (F.greatest("nx", "ny") > self.whole_size)
            & (F.col("rx") + retained <= held(F.col("nx"))) & (F.col("ry") + retained <= held(F.col("ny")))
        )
        shared = F.when(F.col("sketched"), F.lit(SHARED)).otherwise(
            F.least(self._needed(F.least("nx", "ny")), F.lit(SHARED))
        )
        met = (
            (F.col("lx") != F.col("ly"))
            & ((F.col("ly") == F.col("largest")) | (F.col("x") < F.col("y")))
            & (100 * F.least("nx", "ny") >= self.percent * F.greatest("nx", "ny"))
            & F.when(F.col("sketched"), sketches).otherwise(whole)
            & (F.size(F.array_intersect("ax", "ay")) + 1 == shared)
        )
        return x.join(y, "value").where(met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def crossing_pairs(self, lists: DataFrame, labels: DataFrame, tried: DataFrame) -> DataFrame:
        """The untried ones of the pairs that meet."""
        return self.meetings(lists, labels).join(tried, ["a", "b"], "left_anti")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    sketch_size: int = 256,
    whole_size: int | None = None,
) -> DataFrame:
    """Per document: ``id_col``, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` on
    their sets of distinct ``words``-word shingles.  ``component_id`` is the
    smallest id reachable over links, the document's own included; the document
    that bears it is kept.  Null, empty or blank text has an empty set, is
    linked with nothing and kept.  Sets of up to ``whole_size`` shingles
    (``sketch_size``, if not given) are held whole.  A row without id takes part in the links; it
    is kept only where no document of its component has an id.  Rows that
    repeat an id and text get the same answer each.
    """
    job = _Job(docs, id_col, text_col, words, percent, sketch_size, max(whole_size or 0, sketch_size))
    lists = job.lists()
    pairs = stored(job.first_pairs(lists), "minhash-first")
    links = job.confirmed(pairs)
    labels = stored(components(links), "minhash-labels")
    crossing = stored(job.crossing_pairs(lists, labels, pairs), "minhash-crossing")
    links = links.union(job.confirmed(crossing))
    labels = components(links)

    placed = stored(
        job.rows()
        .join(job.nodes.select("set_hash", "node"), "set_hash", "left")
        .join(labels, "node", "left")
        .select("_id", "n_shingles", F.coalesce("label", "node").alias("label")),
        "minhash-placed",
    )
    least = placed.where("label is not null").groupBy("label").agg(F.min("_id").alias("least"))
    own = F.when(F.col("label").isNull(), F.col("_id")).otherwise(F.col("least"))
    return (
        placed.join(least, "label", "left")
        .select(F.col("_id").alias(id_col), "n_shingles", own.alias("component_id"))
        .withColumn(
            "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull())
        )
    )
