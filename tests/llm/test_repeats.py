"""Repeated passages against every window of every text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from toplist.llm.repeats import repeated_ranges, without_repeats

SCHEMA = "doc_id long, text string, n_bytes string, at string"


def expected(texts, window=200):
    seen = Counter()
    for b in texts:
        for k in range(len(b) - window + 1):
            seen[b[k : k + window]] += 1
    out = []
    for b in texts:
        marks = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                marks[k] += 1
                marks[k + window] -= 1
        gone = np.cumsum(marks)[: len(b)] > 0
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((len(b), int(gone.sum()), edges.reshape(-1, 2).tolist(), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé ñ") for _ in range(n))
    passages = [text(n) for n in (90, 140, 205, 230, 330, 700)]
    texts = []
    for _ in range(30):
        parts = [text(rng.randrange(0, 400))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 60)
            parts += [p[cut : len(p) - rng.randrange(0, 60)], text(rng.randrange(0, 150))]
        texts.append("".join(parts))
    texts += [texts[0], texts[1], texts[1], "ab" * 300, "x" * 450, "x" * 199, "y" * 200, "", text(200)]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("group_rows", [100_000, 2])
def test_matches_every_window(spark, monkeypatch, seed, group_rows):
    import toplist.llm.repeats as module

    original = module.repeated_ranges
    monkeypatch.setattr(module, "repeated_ranges", lambda d, t, w: original(d, t, w, group_rows))
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = {r["doc_id"]: r for r in without_repeats(df, carry=["doc_id"]).collect()}
    for i, (size, removed, spans, left) in enumerate(expected([t.encode() for t in texts])):
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"]) == (size, removed), i
        assert [[s["start"], s["end"]] for s in r["spans"]] == spans
        assert bytes(r["kept"]) == left


def test_nulls_and_clashing_columns(spark):
    same = "repeat " * 40
    df = spark.createDataFrame([(None, None, "a", "b"), (1, same, None, "c"), (1, same, None, "c"), (2, "", "", "")], SCHEMA)
    rows = without_repeats(df).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), r["at"]) for r in rows) == [
        ("1", 280, 280, 1, "c"), ("1", 280, 280, 1, "c"), ("2", 0, 0, 0, ""), ("None", 0, 0, 0, "b"),
    ]


def test_whole_characters(spark):
    # The repeat begins and ends inside two-byte characters of one of the texts.
    middle = "z" * 250
    df = spark.createDataFrame([(1, "é" + middle + "é"), (2, "ɩ" + middle + "©")], "doc_id long, text string")
    for whole in (False, True):
        rows = without_repeats(df, whole_characters=whole).collect()
        for r in rows:
            left = bytes(r["kept"])
            if whole:
                assert middle not in left.decode()


def test_empty_table_and_short_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert without_repeats(empty).collect() == []
    short = spark.createDataFrame([(1, "short", "", ""), (2, "short", "", "")], SCHEMA)
    assert repeated_ranges(short).collect() == []
    digest = hashlib.sha256(b"short").hexdigest()
    assert {hashlib.sha256(bytes(r["kept"])).hexdigest() for r in without_repeats(short).collect()} == {digest}
