"""Exact duplicates against plain Python: blocks, odd pairs, ties, repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import toplist.llm.exact_dedup as exact
from toplist.llm.exact_dedup import exact_duplicates

SCHEMA = "doc_id long, text string, row string, name string, bare string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "n", "b", "k") for i, t in rows], SCHEMA)


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        members = groups[bare(t)]
        best = min(members)
        keep = None if best[1] else best[2]
        out.append((i, keep, len(members), hashlib.sha256(bare(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    rows = df.collect()
    assert all(r["kept"] for r in rows if r["group_size"] == 1)
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows], key=repr), rows


def test_names_are_texts(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab é\n漢") for _ in range(n)) for n in [0, 1, 3, 4, 5, 8, 9, 17, 40, 41, 64, 200, 3000]]
    rows = [(None, "x y"), (7, "xy"), (8, None), (9, ""), (10, " \t\n\x0b\x0c\r"), (11, "x y"), (12, "xy\x1f")]
    for k, t in enumerate(base):
        rows.append((100 + k, t))
        rows.append((200 + k, " ".join(t)))  # equal after deleting white space
        rows.append((300 + k, t + "a"))
        rows.append((400 + k, "a" + t))
        rows.append((500 + k, t[: len(t) // 2] + "b" + t[len(t) // 2 + 1 :]))
        rows.append((600 + k, t + t))
    answer, full = got(exact_duplicates(frame(spark, rows), block_bytes=4))
    assert answer == expected(rows)
    for r in full:
        assert r["kept"] == (r["doc_id"] == r["keep_id"]) or r["doc_id"] is None


def test_ties_and_repeated_rows(spark):
    # One row of each group stays, also where rows repeat an id or have none.
    rows = [(5, "a b"), (5, "a b"), (4, "a  b"), (4, "a  b"), (3, "ab"), (None, "c"), (None, "c"), (2, "d "), (1, " d")]
    answer, full = got(exact_duplicates(frame(spark, rows), block_bytes=1))
    assert answer == expected(rows)
    assert sum(r["kept"] for r in full) == 3


def test_hot_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(exact, "ROWS_PER_SLICE", 3)
    rows = [(i, "same block " * 9) for i in range(40)] + [(100 + i, "same block " * 9 + str(i % 7)) for i in range(40)]
    for broadcast in (100_000, 0):
        monkeypatch.setattr(exact, "BROADCAST_KEYS", broadcast)
        assert got(exact_duplicates(frame(spark, rows), block_bytes=3))[0] == expected(rows)


def test_keys_that_collide_are_drawn_anew(spark, monkeypatch):
    honest = exact._keys

    def weak(block, draw):
        if draw:
            return honest(block, draw)
        return F.struct(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"))

    monkeypatch.setattr(exact, "_keys", weak)
    rows = [(i, f"text {i % 3}") for i in range(9)]
    assert got(exact_duplicates(frame(spark, rows)))[0] == expected(rows)
    monkeypatch.setattr(exact, "_keys", lambda block, draw: weak(block, 0))
    with pytest.raises(RuntimeError, match="shared both keys"):
        exact_duplicates(frame(spark, rows))


def test_long_text_and_empty_table(spark):
    long = "word " * 200_000
    rows = [(1, long), (2, long.replace(" ", "\n")), (3, long + "x"), (4, "y" + long)]
    assert got(exact_duplicates(frame(spark, rows)))[0] == expected(rows)
    empty = exact_duplicates(frame(spark, []).where("false"))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_no_python_in_the_plan(spark):
    from toplist.plans.inspect import plan_text

    plan = plan_text(exact_duplicates(frame(spark, [(1, "a"), (2, "a ")])))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
