"""Held-out accuracy of the two classifiers, and the pipeline's stages one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from toplist.llm import quality_classifier
from toplist.llm.language_id import UNDETERMINED, Model, best_temperature, gram_counts, identify, train
from toplist.llm.queries import QUERIES
from toplist.llm.quality_classifier import classify, shape
from toplist.plans.inspect import plan_text

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

SYLLABLES = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["kres", "tok", "zum", "wid"], "cc": ["ñe", "ço", "ãu", "li"]}


def sentence(rng, lang, n=20):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_id_on_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang), lang, None, 0) for i, lang in enumerate(sorted(SYLLABLES) * 60)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    model = train(df.where("doc_id % 3 <> 1 or doc_id > 150"), F.col("text"), F.col("lang"), F.xxhash64("doc_id"))
    found = identify(df.withColumn("score", F.lit("clash")), model, carry=["doc_id", "lang", "score"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) == 1
    assert all(0 <= r["score"] <= 1 for r in found)
    assert 0 < (model.weights != 0).mean() < 0.2  # sparse


def test_language_id_odd_texts(spark):
    df = spark.createDataFrame([(1, None, "aa", None, 0), (2, "", None, None, 0), (None, "12 !!", "aa", None, 0), (4, "ba lo", "aa", None, 0)], DOCS)
    model = train(df, F.col("text"), F.col("lang"), F.xxhash64("doc_id"))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, model).collect()}
    assert found[1] == found[2] == found[None] == (UNDETERMINED, 0.0)
    assert found[4][0] == "aa"
    empty = train(df.limit(0), F.col("text"), F.col("lang"), F.xxhash64("doc_id"))
    assert empty.langs == [] and empty.predict("text") == (UNDETERMINED, 0.0)
    assert identify(df.limit(0), empty).collect() == []


def test_symbols_outside_the_basic_plane_are_no_letters():
    for text in ("😀 123", "🙂🙂", "𝟘𝟙", "\U0001f1e9\U0001f1ea!"):
        assert len(gram_counts(text)[0]) == 0, text
    assert np.array_equal(gram_counts("ba 😀lo🙂")[1], gram_counts("ba lo")[1])
    assert len(gram_counts("𐐨𠀀")[0]) > 0
    model = Model(["aa"], np.ones(1 << 15), np.ones((1, (1 << 15) + 1)), 1.0)
    assert model.predict("😀 123") == (UNDETERMINED, 0.0) and model.predict("ba")[0] == "aa"


def test_gram_counts_take_the_whole_text():
    assert len(gram_counts("1 2 3 !")[0]) == 0
    assert gram_counts("Ab, ab")[1].sum() == gram_counts("ab ab")[1].sum()
    assert gram_counts("ab " * 40000)[1].sum() > 3 * 100_000


def test_temperature_softens_wrong_certainty():
    logits = np.array([[9.0, 0.0]] * 10)
    assert best_temperature(logits, np.array([0] * 6 + [1] * 4)) > 5
    assert best_temperature(np.empty((0, 2)), np.empty(0, dtype=int)) == 1.0
    assert Model([], np.ones(1), np.zeros((0, 2)), 1.0).predict(None)[0] == UNDETERMINED


def test_classifier_uses_text_and_site(spark):
    rng = random.Random(2)
    good, bad = [f"fine{i}" for i in range(60)], [f"junk{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(600):
        is_good = rng.random() < (0.9 if i % 3 else 0.3)
        pool = (good if is_good else bad) + [f"both{k}" for k in range(60)]
        rows.append((i, " ".join(rng.choices(pool, k=30)), "en", "clean.site" if i % 3 else "bad.site", 0))
        if i % 2 == 0:
            marks.append((i, int(is_good)))
    rows += [(1000, None, "en", "clean.site", 0), (1001, "", "en", "bad.site", 0), (1002, "unknownword", None, None, 0)]
    labels = spark.createDataFrame([*marks, (2000, 1), (1, None)], "doc_id long, label int")
    found = {r["doc_id"]: r for r in classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(found) == len(rows)
    truth = {i: "fine" in t for i, t, *_ in rows[:600]}
    assert np.mean([found[i]["kept"] == truth[i] for i in range(1, 600, 2)]) > 0.97
    assert found[1000]["probability"] > 0.6 > found[1001]["probability"]
    assert 0 < found[1002]["probability"] < 1


def test_classifier_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, label int")
    rows = spark.createDataFrame([(1, "a b", "en", "s", 0), (None, None, None, None, None)], DOCS)
    assert [r["probability"] for r in classify(rows, labels).collect()] == pytest.approx([0.5, 0.5])
    assert classify(rows.limit(0), labels).collect() == []


def test_shapes():
    assert shape("Ab12##") == "Aa0#" and shape("") == ""


def test_registered_queries_run_over_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op6_language_id", "op10_quality_classifier"):
        rows = QUERIES[name](spark, SF).collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) == docs
    held = [r for r in QUERIES["op6_language_id"](spark, SF).collect() if r["held_out"]]
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.9


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(None, "same text " * 30, None, None, None), (None, "same text " * 30, None, None, None), (-1, None, "en", "s", 0)], docs.schema)
    now = docs.unionByName(odd)
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        assert now.columns == columns
        counts.append(now.count())
    assert counts[0] > counts[1] >= counts[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert sum(r["piece"] == 0 for r in last) == counts[-1]
    assert max(r["offset"] + r["length"] for r in last) <= 1024


def test_near_dedup_keeps_all_texts_of_a_repeated_id(spark):
    rng = random.Random(7)
    a, b, c = (" ".join(f"{name}{rng.randrange(500)}" for _ in range(120)) for name in "abc")
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (1, a, "en", "s", 0), (2, b + " end", "en", "s", 0), (3, c, "en", "s", 0), (None, c, "en", "s", 0)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, a), (1, b), (3, c)]


def test_mixing_counts_rows_of_a_repeated_id_apart(spark):
    # 210 words: source a is taken three times (30 words), b takes the other 180 as 18 of its 20 rows.
    rows = [(7, "x " * 10, "en", "a", 0)] + [(7, "y " * 9 + str(i // 2), "en", "b", 0) for i in range(20)]
    taken = corpus_pipeline.mixing(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted(r["source"] for r in taken) == ["a"] * 3 + ["b"] * 18
    assert all(sum(r["text"] == "y " * 9 + str(k) for r in taken) <= 2 for k in range(10))


def test_pipeline_of_an_empty_table(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame([], stage(spark, now, SF).schema) if stage is not corpus_pipeline.packing else stage(spark, now, SF)
    assert now.count() == 0


def test_classifier_moves_no_text_to_the_labels(spark, monkeypatch):
    plans = []
    real = quality_classifier.likelihood_ratios
    monkeypatch.setattr(quality_classifier, "likelihood_ratios", lambda df: plans.append(plan_text(df)) or real(df))
    rows = [(i, f"good words {i}" if i % 2 else f"bad words {i}", "l", "s", 0) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, label int")
    assert classify(spark.createDataFrame(rows, DOCS), labels).count() == 40
    # The plan is one for any number of labels.
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
    assert "words" in plans[0] and "text" not in plans[0]
