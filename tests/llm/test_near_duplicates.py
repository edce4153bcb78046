"""Near duplicates against all pairs, on random families of edited texts and on odd rows."""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
import pytest

from toplist.llm import shingles as shingle_module
from toplist.llm.components import components
from toplist.llm.near_duplicates import _Job, near_duplicates, shared_at_least
from toplist.plans.inspect import plan_text

SCHEMA = "doc_id long, text string, node string, _id string"


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    width = min(size, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def expected(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in sets}


def families(seed, n_words):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(4000))
    line = [word() for _ in range(40)]
    rows, next_id = [], 0
    for _ in range(14):
        base = [word() for _ in range(n_words)]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, n_words // 40))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.4:
                copy = copy + line
            rows.append((next_id, (" " if rng.random() < 0.5 else "\n\t ").join(copy)))
            next_id += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n_words", "size"), [(1, 30, 5), (2, 120, 4), (3, 400, 5)])
def test_components_match_all_pairs(spark, seed, n_words, size):
    rows = families(seed, n_words)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    found = near_duplicates(df, words=size).collect()
    want = expected(rows, size, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_small_sketches_lose_no_link(spark):
    # Most sets are larger than what is held whole, so their links rest on sketches.
    rows = families(4, 120)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    found = near_duplicates(df, words=4, sketch_size=48, whole_size=48).collect()
    want = expected(rows, 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: c for i, (_, c) in want.items()}


def test_odd_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(30000))
    rows = [
        (5, None, None, None), (6, "", None, None), (7, " \n\t", None, None),
        (8, "One two", None, None), (9, "one  TWO", None, None), (10, "one two three", None, None),
        (11, "one two", None, None), (11, "one two", None, None),
        (None, "lonely text of five words", None, None), (None, "one two", None, None),
        (3, long_text, None, None), (4, long_text + " end", None, None),
    ]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found), key=str)
    assert got == sorted(
        [
            (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True),
            (8, 1, 8, True), (9, 1, 8, False), (10, 1, 10, True), (11, 1, 8, False), (11, 1, 8, False),
            (None, 1, None, True), (None, 1, 8, False),
            (3, 29996, 3, True), (4, 29997, 3, False),
        ],
        key=str,
    )


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    labels = {r["node"]: r["label"] for r in found}
    assert len(labels) == len(found)
    assert labels == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {199: 199, 200: 199}


def test_bound_on_shared_values():
    assert shared_at_least(96, 80) == 56
    assert shared_at_least(1, 80) == 0


def test_one_family_of_heavy_edits(spark):
    # Members far from each other hang together through central ones only.
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            copy[at] = f"e{i}.{at}"
        rows.append((i, " ".join(copy)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    for whole in (256, 96):
        found = near_duplicates(df, words=4, whole_size=whole).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected(rows, 4, 80)


def passage_rows(own):
    """Twelve texts of one passage of 400 words and ``own`` words of their own."""
    passage = [f"p{i}" for i in range(400)]
    return [(i, " ".join([*passage, *(f"o{i}.{j}" for j in range(own))]), "x", "y") for i in range(12)]


@pytest.mark.parametrize(("own", "met"), [(60, True), (150, False)])
def test_pairs_that_share_a_passage_come_out_once(spark, own, met):
    # 60 own words: close to the threshold, so tried.  150: over what sets of one size may differ in, so not.
    job = _Job(spark.createDataFrame(passage_rows(own), SCHEMA), "doc_id", "text", 4, 80, 256, 256)
    nobody = spark.createDataFrame([], "node long, label long")
    found = [(r["a"], r["b"]) for r in job.meetings(job.lists(), nobody).collect()]
    assert len(found) == len(set(found)) == (66 if met else 0)


def test_sets_are_made_of_few_texts_at_a_time():
    texts = pa.array([f"a b{i} c d e".encode() for i in range(2500)], type=pa.binary())
    batch = pa.RecordBatch.from_arrays([texts], names=["_text"])
    made = list(shingle_module.set_mapper(4, 256, 256, [])(iter([batch])))
    assert sum(b.num_rows for b in made) == 2500 and max(b.num_rows for b in made) <= 1000
    assert len(shingle_module._hashes) <= shingle_module.REMEMBERED_WORDS <= 100_000


def test_only_sets_of_the_pairs_are_shuffled(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    texts += [t.replace("x29", "y") for t in texts[:2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    job = _Job(docs, "doc_id", "text", 4, 80, 256, 256)
    node = {r["h"]: r["node"] for r in job.nodes.selectExpr("hex(set_hash) h", "node").collect()}
    name = {r["_id"]: node[r["h"]] for r in job.rows().selectExpr("_id", "hex(set_hash) h").collect()}
    pairs = [(name[0], name[40]), (name[1], name[41]), (name[2], name[3])]
    found = job.estimated(spark.createDataFrame(pairs, "a long, b long"))
    assert {(r["a"], r["b"]) for r in found.collect()} == set(pairs[:2])
    # The sets meet the nodes asked for before they meet a pair.
    assert "LeftSemi" in plan_text(found)
