"""Extra columns named like anything inside the operators come through a stage unchanged."""

from __future__ import annotations

import random
import re
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import toplist.llm
from toplist.llm.mixing import mix_sources
from toplist.llm.packing import pack
from toplist.llm.quality_rules import quality_rules

FILES = [*Path(toplist.llm.__file__).parent.glob("*.py"), Path(corpus_pipeline.__file__)]
OWN = {"doc_id", "text", "lang", "source", "n_chars"}
#: Every quoted word of the subpackage that could be a column.
NAMES = sorted({x for f in FILES for x in re.findall(r'"([a-z_][a-z0-9_]*)"', f.read_text(encoding="utf-8"))} - OWN)


def prose(rng, n):
    common = ["the", "of", "and", "to", "in", "is", "a", "that"]
    return " ".join(rng.choice(common) if rng.random() < 0.45 else rng.choice("bcdfgh") + "ord" + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(60, 120)) for _ in range(24)]
    texts += [texts[0], texts[1] + " end", None, "", "junk #### $$$$"]
    rows = [(i, t, "en", rng.choice(["web", "books", None]), len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.cache()


def wide(docs):
    assert len(NAMES) > 150 and {"kept", "_text", "ref_lang", "_hash", "_name", "copies", "copy", "_key", "_row", "bin", "fill", "group", "row", "_in"} <= set(NAMES)
    return docs.select("*", *[F.concat(F.lit(n + "-"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=lambda f: f.__name__)
def test_stage_keeps_columns(spark, docs, stage):
    want = sorted((tuple(r) for r in stage(spark, docs, "").collect()), key=repr)
    got = stage(spark, wide(docs), "")
    assert got.columns == wide(docs).columns
    rows = got.collect()
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in NAMES)
    if stage is not corpus_pipeline.mixing:  # its order follows a hash of all columns only among rows of one id
        assert sorted((tuple(r[c] for c in docs.columns) for r in rows), key=repr) == want
    assert rows


def test_operators_keep_columns(spark, docs):
    pieces = wide(docs).withColumn("length", F.lit(10).cast("long"))
    packed = pack(pieces, 25).collect()
    assert len(packed) == docs.count()
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in packed for n in NAMES if n not in ("length", "sequence_id", "offset"))
    outputs = {"size", "source_size", "target", "copies", "taken"}
    mixed = mix_sources(wide(docs), [2.0, 1.0], carry=NAMES).collect()
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in mixed for n in NAMES if n not in outputs)
    outputs = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"}
    judged = quality_rules(wide(docs)).collect()
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in judged for n in NAMES if n not in outputs)
