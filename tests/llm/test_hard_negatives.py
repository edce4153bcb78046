"""Hard negatives against all pairs: skewed lengths, ties, repeated rows, odd vectors; the pruning loses nothing."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from toplist.llm.hard_negatives import Bucket, Rows, exact_scores, hard_negatives, window_of
import pyarrow as pa

SCHEMA = "vec_id long, embedding array<float>, label int, row string, bucket string, score string, length string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "b", "s", "l") for r in rows], SCHEMA)


def expected(rows, every=10):
    """By plain Python over all pairs; the row's place stands in for its identity."""
    ok = []
    for i, (vec_id, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for i, vec_id, v, label in ok:
        if vec_id is None or vec_id % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=False))
        scored = [(score(w), j, lab == label) for k, j, w, lab in ok if k != i]
        for ps, p in sorted([s[:2] for s in scored if s[2]], key=order)[:5]:
            allowed = [s[:2] for s in scored if not s[2] and 50 * ps <= 100 * s[0] <= 95 * ps]
            for rank, (ns, n) in enumerate(sorted(allowed, key=order)[:3], 1):
                out.append((vec_id, p, rank, n, ps, ns))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(rng, n, dim=8, labels=4):
    rows = []
    for i in range(n):
        size = 3.0 ** rng.randrange(-2, 3)  # skewed lengths
        rows.append((i, [rng.gauss(0, size) for _ in range(dim)], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize(("bucket_rows", "chunk_rows"), [(4096, 1024), (16, 4)])
def test_all_pairs(spark, bucket_rows, chunk_rows):
    rng = random.Random(bucket_rows)
    rows = vectors(rng, 200)
    # Ties, repeated rows and ids, rows without id, short, empty and zero vectors, rows that take no part.
    rows += [(300, rows[0][1], 1), (301, rows[0][1], 1), (20, rows[3][1], 2), (20, rows[3][1], 2), (None, rows[5][1], 0)]
    rows += [(None, rows[5][1], 3), (310, [1.0, 2.0], 0), (320, [], 1), (330, [0.0] * 8, 2), (340, [-0.001] * 8, 2)]
    rows += [(350, None, 1), (360, [1.0] * 8, None), (370, [1.0, None], 1), (380, [float("nan")] * 8, 1), (390, [float("inf")], 1)]
    df = frame(spark, rows)
    result = hard_negatives(df, F.col("vec_id") % 10 == 0, bucket_rows=bucket_rows, chunk_rows=chunk_rows)
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(result) == expected(rows)


def test_one_label_few_rows_and_empty_table(spark):
    rows = [(10, [1.0, 1.0], 1), (11, [1.0, 0.5], 1), (12, [0.4, 0.4], 2)]
    assert got(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == expected(rows) != []
    assert got(hard_negatives(frame(spark, rows[:2]), F.col("vec_id") % 10 == 0)) == []
    assert hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_window_of_scores():
    for score in range(-300, 300):
        least, most = window_of(score, 50, 95)
        for x in range(-320, 320):
            assert (least <= x <= most) == (50 * score <= 100 * x <= 95 * score)


def test_scores_beyond_doubles_are_exact():
    m = np.array([[2.0**40, 3.0], [2.0**40 + 1, -5.0], [2.0**62, 2.0**62]])
    q = np.array([2.0**20 + 1, 7.0])
    assert exact_scores(m[:2], q).tolist() == [2**40 * (2**20 + 1) + 21, (2**40 + 1) * (2**20 + 1) - 35]
    assert exact_scores(m[2:], q).tolist() == [2**63 - 1]


def test_coordinate_pruning_keeps_every_row_that_reaches_the_bound():
    rng = np.random.default_rng(3)
    values = np.floor(rng.normal(0, 100, (400, 12)) * rng.choice([0.1, 1, 4], (400, 1)))
    values[:40, 1:] = np.floor(values[:40, 1:] / 50)  # near one axis, where ranges are narrow
    table = pa.table({
        "row": np.arange(400), "id": np.arange(400), "label": np.zeros(400, dtype=np.int64),
        "vector": pa.array([list(v) for v in values], type=pa.list_(pa.float64())),
        "length": np.sqrt((values**2).sum(axis=1)),
    })
    bucket, pruned = Bucket(Rows(table), 12), 0
    for q in values[:120]:
        scores = values @ q
        for share in (0.3, 0.6, 0.9, 0.99):
            least = float(np.floor(share * scores.max()))
            left = bucket.candidates(q, float(np.sqrt(q @ q)), least)
            assert set(np.flatnonzero(scores >= least)) <= set(left)
            pruned += 400 - len(left)
    assert pruned > 20_000
