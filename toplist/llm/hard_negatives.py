"""Hard negatives by inner product, with LEMP-style coordinate pruning.

Vectors are laid out by label and length in *length buckets* of a bounded
number of rows.  A bucket holds, for every coordinate, the sorted list of its
unit vectors' values there.  An anchor that needs a score of at least ``t``
against a bucket whose longest vector is ``l`` needs a cosine of at least
``c = t / (|anchor| * l)``: the bucket is skipped where ``c > 1``; otherwise a
vector can only qualify when its value at a coordinate lies in the range that
leaves room for that cosine.  The ranges of the anchor's ``focus`` largest
coordinates are looked up in the sorted lists and intersected; the candidates
left are verified by their exact integer inner products.

The bounds ``t`` come from real scores, so nothing is lost: first every anchor
meets the rows of its own bucket, which gives a floor for its last positive;
then one bucket of other labels, which gives floors for its negatives.

Anchors travel in chunks and meet buckets chunk by chunk: a task holds one
bucket and one chunk, both of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toplist.llm.common import stored

# Rows of a length bucket and anchors of a chunk (about; buckets are ranges found by sampling).
BUCKET_ROWS = 4096
CHUNK_ROWS = 1024
# Coordinates of an anchor that are looked up in the sorted lists.
FOCUS = 6
# Whole numbers up to here are exact as doubles; the range of a long.
EXACT = float(1 << 53)
LONG = (1 - (1 << 63), (1 << 63) - 1)
# Added to cosine bounds: more than the rounding of a unit vector's values.
SLACK = 1e-9

_ROW = "row long, id long, label {label}, vector array<double>, length double"


def _read(scale: int):
    """``mapInArrow`` function: rows whose components are all finite, as floored multiples, with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten().cast(pa.float64())
            values = np.floor(flat.to_numpy(zero_copy_only=False) * scale)  # nulls are read as not a number
            sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            ends = np.r_[0, np.cumsum(sizes)]
            bad = np.r_[0, np.cumsum(~np.isfinite(values))]
            keep = np.flatnonzero(bad[ends[1:]] == bad[ends[:-1]])
            vectors = [values[ends[i] : ends[i + 1]] for i in keep]
            out = batch.take(pa.array(keep))
            columns = {
                "row": out["row"], "id": out["id"], "label": out["label"],
                "vector": pa.array(vectors, type=pa.list_(pa.float64())),
                "length": pa.array([_length(v) for v in vectors], type=pa.float64()), "anchor": out["anchor"],
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _length(v: np.ndarray) -> float:
    """Euclidean length, without overflow on the way."""
    top = np.abs(v).max() if len(v) else 0.0
    return float(top * np.sqrt(((v / top) ** 2).sum())) if top else 0.0


class Rows:
    """Rows of a bucket or chunk: ids, labels, lengths and the vectors as one matrix (short ones padded with 0)."""

    def __init__(self, table: pa.Table):
        self.table, self.n = table, table.num_rows
        self.row = table["row"].to_numpy()
        self.length = table["length"].to_numpy()
        self.label = np.array(table["label"].to_pylist(), dtype=object)
        ids = table["id"]
        self.nameless = np.asarray(ids.is_null())
        self.id = ids.fill_null(0).to_numpy()
        lists = table["vector"].combine_chunks()
        sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
        self.dim = int(sizes.max()) if self.n else 0
        self.matrix = np.zeros((self.n, self.dim))
        at = np.repeat(np.arange(self.n), sizes)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.matrix[at, place] = lists.flatten().to_numpy()

    def widened(self, dim: int) -> np.ndarray:
        return self.matrix if self.dim == dim else np.pad(self.matrix, ((0, 0), (0, dim - self.dim)))


def exact_scores(matrix: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; as int64 where they fit it for sure, else as Python integers kept to a long's range."""
    top = (np.abs(matrix).max() if matrix.size else 0.0) * (np.abs(q).max() if q.size else 0.0) * max(1, len(q))
    if top < EXACT:
        return (matrix @ q).astype(np.int64)
    whole = [int(x) for x in q]
    sums = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in matrix]
    return np.array([min(max(s, LONG[0]), LONG[1]) for s in sums], dtype=np.int64)


class Bucket:
    """A length bucket: its rows, longest length and sorted coordinate lists."""

    def __init__(self, rows: Rows, dim: int):
        self.rows, self.matrix = rows, rows.widened(dim)
        self.longest = float(rows.length.max()) if rows.n else 0.0
        unit = self.matrix / np.where(rows.length > 0, rows.length, 1.0)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(unit, self.order, axis=0)

    def candidates(self, q: np.ndarray, length: float, least: float, focus: int = FOCUS) -> np.ndarray:
        """Places of all rows that can score ``least`` or more against ``q``."""
        everything = np.arange(self.rows.n)
        reach = length * self.longest
        # A bound of 0 or less holds for vectors of any direction.
        if least <= 0 or not np.isfinite(reach):
            return everything
        if reach == 0 or least > reach * (1 + SLACK):
            return everything[:0]
        unit = q / length
        spread = np.arccos(min(1.0, max(-1.0, least / reach - SLACK)))
        at = np.argsort(-np.abs(unit), kind="stable")[:focus]
        turn = np.arccos(np.clip(unit[at], -1.0, 1.0))
        low = np.cos(np.minimum(np.pi, turn + spread)) - SLACK
        high = np.cos(np.maximum(0.0, turn - spread)) + SLACK
        ranges = sorted(
            (int(np.searchsorted(self.lists[:, f], b, side="right")) - a, a, int(f))
            for f, a, b in ((f, int(np.searchsorted(self.lists[:, f], lo, side="left")), hi)
                            for f, lo, hi in zip(at, low, high, strict=True))
        )
        left = None
        for n, a, f in ranges:
            if n <= 0:
                return everything[:0]
            if n == self.rows.n:
                break  # this range and the wider ones hold every row
            found = np.zeros(self.rows.n, dtype=bool)
            found[self.order[a : a + n, f]] = True
            left = found if left is None else left & found
        return everything if left is None else np.flatnonzero(left)


def _first(scores: np.ndarray, rows: Rows, at: np.ndarray, k: int) -> np.ndarray:
    """Places in ``at`` of the first ``k``: higher scores, rows with an id, smaller ids."""
    if len(at) > k:
        # Rows under the k-th score are out; its ties stay.
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(at))
    order = np.lexsort((rows.row[at[some]], rows.id[at[some]], rows.nameless[at[some]], -scores[some]))
    return some[order[:k]]


def _same(labels: np.ndarray, label) -> np.ndarray:
    return np.fromiter((x == label for x in labels), dtype=bool, count=len(labels))


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one bucket and one chunk: every anchor's first ``k`` other rows of its label, if they reach its ``floor``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {x: [] for x in ("row", "other", "id", "score")}
        if left.num_rows and right.num_rows:
            bucket_rows, anchors = Rows(left), Rows(right)
            dim = max(bucket_rows.dim, anchors.dim)
            bucket, q = Bucket(bucket_rows, dim), anchors.widened(dim)
            floors = right["floor"].to_pylist()
            for label in set(anchors.label):
                same = _same(bucket_rows.label, label)
                if not same.any():
                    continue
                for a in np.flatnonzero(_same(anchors.label, label)):
                    least = -np.inf if floors[a] is None else floors[a]
                    at = bucket.candidates(q[a], anchors.length[a], least)
                    at = at[same[at] & (bucket_rows.row[at] != anchors.row[a])]
                    scores = exact_scores(bucket.matrix[at], q[a])
                    if np.isfinite(least):
                        at, scores = at[scores >= least], scores[scores >= least]
                    for i in _first(scores, bucket_rows, at, k):
                        out["row"].append(anchors.row[a])
                        out["other"].append(bucket_rows.row[at[i]])
                        out["id"].append(None if bucket_rows.nameless[at[i]] else bucket_rows.id[at[i]])
                        out["score"].append(scores[i])
        return pa.table({x: pa.array(v, type=pa.int64()) for x, v in out.items()})

    return run


def _floors(k: int) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket: the ``k``-th best score of each of its anchors against rows of its label there."""

    def run(table: pa.Table) -> pa.Table:
        rows = Rows(table)
        at, floors = [], []
        anchors = np.flatnonzero(table["anchor"].to_numpy(zero_copy_only=False).astype(bool))
        for label in set(rows.label[anchors]):
            same = np.flatnonzero(_same(rows.label, label))
            if len(same) <= k:
                continue
            for a in anchors[_same(rows.label[anchors], label)]:
                scores = exact_scores(rows.matrix[same[same != a]], rows.matrix[a])
                at.append(rows.row[a])
                floors.append(np.partition(scores, len(scores) - k)[len(scores) - k])
        return pa.table({"row": pa.array(at, type=pa.int64()), "floor": pa.array(floors, type=pa.int64())})

    return run


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest whole ``x`` with ``low * score <= 100 * x <= high * score``."""
    return -(-low * score // 100), high * score // 100


def _negatives(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one bucket and one chunk: for every anchor and positive the first ``k`` rows of other labels in its window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {x: [] for x in ("row", "place", "other", "id", "score")}
        if left.num_rows and right.num_rows:
            bucket_rows, anchors = Rows(left), Rows(right)
            dim = max(bucket_rows.dim, anchors.dim)
            bucket, q = Bucket(bucket_rows, dim), anchors.widened(dim)
            scores_of = right["scores"].to_pylist()
            floors_of = [dict(x or ()) for x in right["floors"].to_pylist()]
            for label in set(anchors.label):
                other = ~_same(bucket_rows.label, label)
                if not other.any():
                    continue
                for a in np.flatnonzero(_same(anchors.label, label)):
                    windows = []
                    for place, score in enumerate(scores_of[a]):
                        least, most = window_of(score, low, high)
                        floor = floors_of[a].get(place)
                        least = least if floor is None else max(least, floor)
                        if least <= most:
                            windows.append((place, least, most))
                    if not windows:
                        continue
                    at = bucket.candidates(q[a], anchors.length[a], min(w[1] for w in windows))
                    at = at[other[at]]
                    scores = exact_scores(bucket.matrix[at], q[a])
                    for place, least, most in windows:
                        some = np.flatnonzero((scores >= least) & (scores <= most))
                        for i in some[_first(scores[some], bucket_rows, at[some], k)]:
                            out["row"].append(anchors.row[a])
                            out["place"].append(place)
                            out["other"].append(bucket_rows.row[at[i]])
                            out["id"].append(None if bucket_rows.nameless[at[i]] else bucket_rows.id[at[i]])
                            out["score"].append(scores[i])
        return pa.table({x: pa.array(v, type=pa.int64()) for x, v in out.items()})

    return run


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group, with their ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").isNull(), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    bucket_rows: int = BUCKET_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per anchor and positive the ``negatives`` hardest rows of other labels.

    ``anchor`` tells which rows are anchors (false where null).  Components
    become ``floor(scale * x)``; rows with a null label, a null vector or a null
    or non-finite component (or one whose multiple is beyond a double) take no part.  Shorter vectors count as padded with
    zeros; an empty one scores 0 with all.  Scores beyond a long are kept at its
    ends.  An anchor's positives are its first ``positives`` other rows of its
    label, by score and then smaller id (rows without id last); a row that
    repeats the anchor's id is another row, and every row of a repeated anchor
    is an anchor.  A negative's score must lie from ``low`` to ``high`` percent of
    the positive's, ends included; a negative positive score has none.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``.
    """
    label_type = vectors.schema[label_col].dataType.simpleString()
    given = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where("label is not null and vector is not null")
    row = _ROW.format(label=label_type)
    read = stored(
        given.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_read(scale), row + ", anchor boolean"),
        "negatives-read",
    )
    total, of_anchors = read.agg(F.count("*"), F.count_if("anchor")).first()
    buckets = max(1, -(-total // bucket_rows))
    rows = stored(
        read.repartitionByRange(buckets, "label", "length", "row").withColumn("bucket", F.spark_partition_id()),
        "negatives-buckets",
    )
    columns = ["row", "id", "label", "vector", "length"]
    chunks = max(1, -(-of_anchors // chunk_rows))
    anchors = stored(
        rows.where("anchor").select(*columns, "bucket").repartitionByRange(chunks, "label", "row")
        .withColumn("chunk", F.spark_partition_id()),
        "negatives-anchors",
    )

    def meet(pairs: DataFrame, asking: DataFrame, run: Callable, schema: str) -> DataFrame:
        """``run`` on every (bucket, chunk) of ``pairs``, with that bucket's rows and that chunk's anchors."""
        pairs = stored(pairs, "negatives-pairs")
        left = rows.select(*columns, "bucket").join(pairs, "bucket")
        # Columns of its own: both sides of a co-group may not come from one scan.
        right = asking.join(pairs.select(F.col("chunk").alias("chunk"), F.col("bucket").alias("bucket")), "chunk")
        return left.groupBy("bucket", "chunk").cogroup(right.groupBy("bucket", "chunk")).applyInArrow(run, schema)

    # Positives: buckets and chunks that share a label.
    floors = rows.select(*columns, "anchor", "bucket").groupBy("bucket").applyInArrow(
        _floors(positives), "row long, floor long"
    )
    asking = anchors.drop("bucket").join(floors, "row", "left")
    shared = (
        rows.select("bucket", "label").distinct().join(anchors.select("chunk", "label").distinct(), "label")
        .select("bucket", "chunk").distinct()
    )
    found = meet(shared, asking, _positives(positives), "row long, other long, id long, score long")
    best = stored(_ranked(found, ["row"], positives), "negatives-positives")

    # Negatives: first one bucket away from the anchor's own, for floors; then all buckets.
    scores = best.groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores")
    )
    asking = anchors.join(scores, "row")
    schema = "row long, place long, other long, id long, score long"
    run = _negatives(negatives, low, high)
    kind = "map<long,long>"
    met = meet(
        anchors.select("chunk", F.pmod(F.col("bucket") + buckets // 2, F.lit(buckets)).alias("bucket")).distinct(),
        asking.drop("bucket").withColumn("floors", F.lit(None).cast(kind)), run, schema,
    )
    last = _ranked(met, ["row", "place"], negatives).where(F.col("rank") == negatives)
    pilot = last.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("floors"))
    asking = stored(asking.drop("bucket").join(pilot, "row", "left"), "negatives-asking")
    every = rows.select("bucket").distinct().withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    hard = _ranked(meet(every, asking, run, schema), ["row", "place"], negatives).select(
        "row", (F.col("place") + 1).cast("int").alias("of"), "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    first = best.select("row", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        hard.join(first, ["row", "of"])
        .join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
