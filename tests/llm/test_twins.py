"""Plain-Python twins of the weighted sampler, of FTRL and of the site posteriors."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from toplist.llm.fingerprints import BITS, SHIFT, STEPS, fingerprints, signatures
from toplist.llm.language_id import BUCKETS, Ftrl, Training
from toplist.llm.quality_classifier import STRENGTHS, classify


def long_hash(value, seed):
    return xxhash.xxh64_intdigest((value % 2**64).to_bytes(8, "little"), seed)


def int_hash(value, seed):
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


def sample(word, weight, k):
    """Order and name of one term's draw, by the formulas of consistent weighted sampling."""
    term = 42 if word is None else xxhash.xxh64_intdigest(word.encode(), 42)
    h = int_hash(k, long_hash(term, 42))
    more = int_hash(k, long_hash(h, 42))
    part = lambda x, shift, bits: ((x >> shift) & (2**bits - 1)) + 0.5
    r = -math.log(part(h, 0, 20) * part(h, 20, 20) * 2.0**-40)
    b = part(h, 40, 24) * 2.0**-24
    c = -math.log(part(more, 0, 32) * part(more, 32, 32) * 2.0**-64)
    t = math.floor(math.log(weight) / r + b)
    place = math.floor((math.log(c) - r * (t - b + 1) + SHIFT) * STEPS)
    name = long_hash(t, long_hash(h, 42)) & (2**BITS - 1)
    return place, name


def test_weighted_sampler(spark):
    rng = random.Random(4)
    texts = ["", "one", "one one two", "a b c d e f g"] + [" ".join(rng.choice(["la", "ma", "é", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["samples"] for r in signatures(df, ["doc_id"], "text", 32).collect()}
    same = total = 0
    for i, text in enumerate(texts):
        counts = Counter(re.findall("[^\x20\x09-\x0D]+", text)) or {None: 1}
        for k in range(32):
            total += 1
            same += got[i][k] == min(sample(w, n, k) for w, n in counts.items())[1]
    # Java's and C's logarithms may differ in the last digit.
    assert same >= 0.995 * total


def test_collision_rate_is_generalised_jaccard(spark):
    a, b = Counter({f"w{i}": 1 + i % 4 for i in range(40)}), Counter({f"w{i}": 1 + i % 3 for i in range(10, 50)})
    want = sum((a & b).values()) / sum((a | b).values())
    df = spark.createDataFrame([(0, " ".join(a.elements())), (1, " ".join(b.elements()))], "doc_id long, text string")
    x, y = (r["fingerprint"] for r in fingerprints(df, samples=600).orderBy("doc_id").collect())
    step = BITS // 4
    same = np.mean([x[i : i + step] == y[i : i + step] for i in range(0, len(x), step)])
    assert abs(same - want) < 4 * math.sqrt(want * (1 - want) / 600)


def test_ftrl_by_coordinates():
    p, rng = Training(), random.Random(9)
    model, z, n = Ftrl(3, p), {}, {}
    rows = [(sorted(rng.sample(range(12), 4)) + [BUCKETS], [rng.random() for _ in range(4)] + [1.0], rng.randrange(3)) for _ in range(120)]

    def weight(c, i):
        if abs(z.get((c, i), 0.0)) <= p.l1:
            return 0.0
        return -(z[c, i] - math.copysign(p.l1, z[c, i])) / ((p.beta + math.sqrt(n[c, i])) / p.alpha + p.l2)

    for at, x, label in rows:
        model.step(np.array(at), np.array(x), label)
        w = {(c, i): weight(c, i) for c in range(3) for i in at}
        logits = [sum(w[c, i] * v for i, v in zip(at, x, strict=True)) for c in range(3)]
        top = max(logits)
        chance = [math.exp(v - top) for v in logits]
        for c in range(3):
            error = chance[c] / sum(chance) - (c == label)
            for i, v in zip(at, x, strict=True):
                g, old = error * v, n.get((c, i), 0.0)
                sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / p.alpha
                z[c, i] = z.get((c, i), 0.0) + g - sigma * w[c, i]
                n[c, i] = old + g * g
    got = model.weights(slice(None))
    want = np.zeros_like(got)
    for c, i in z:
        want[c, i] = weight(c, i)
    assert np.allclose(got, want, atol=1e-12) and (got != 0).sum() > 10


def strength(groups, mean):
    """Method of moments over ``(good, n, own mean)`` groups."""
    excess = sum(n * (g / n - mean(k)) ** 2 for k, g, n in groups) - sum(mean(k) * (1 - mean(k)) for k, _, _ in groups)
    between = excess / sum(n for _, _, n in groups)
    spread = sum(mean(k) * (1 - mean(k)) for k, _, _ in groups) / len(groups)
    found = spread / between - 1 if between > 0 else STRENGTHS[1]
    return min(max(found, STRENGTHS[0]), STRENGTHS[1])


def test_site_posteriors(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(400):
        host, path = rng.choice(["h1", "h2", "h3", None]), rng.choice(["p1", "p2", None])
        rows.append((i, "word" + str(i % 7), path, host, 0))
        if i % 2 == 0:
            chance = {"h1": 0.9, "h2": 0.2}.get(host, 0.6) * (0.5 if path == "p2" else 1)
            marks.append((i, int(rng.random() < chance)))
    # A repeated row, an id with two labels (the smaller counts), a label without a document.
    rows.append(rows[0])
    marks += [(2, 0), (2, 1), (9999, 1)]
    label = {}
    for i, y in marks:
        label[i] = min(label.get(i, 1), y)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = classify(docs, spark.createDataFrame(marks, "doc_id long, label int")).collect()
    assert len(found) == len(rows)

    known = [(r[3], r[2], label[r[0]]) for r in rows if r[0] in label]
    hosts, paths = {}, {}
    for h, q, y in known:
        for table, key in ((hosts, h), (paths, (h, q))):
            good, n = table.get(key, (0, 0))
            table[key] = (good + y, n + 1)
    prior = (sum(g for g, _ in hosts.values()) + 1) / (len(known) + 2)
    host_strength = strength([(h, g, n) for h, (g, n) in hosts.items()], lambda _: prior)
    share = {h: (g + host_strength * prior) / (n + host_strength) for h, (g, n) in hosts.items()}
    path_strength = strength([(k, g, n) for k, (g, n) in paths.items()], lambda k: share[k[0]])
    by_id = {r[0]: r for r in rows}
    for r in found:
        _, _, q, h, _ = by_id[r["doc_id"]]
        own, mine = label.get(r["doc_id"], 0), int(r["doc_id"] in label)
        g, n = hosts.get(h, (0, 0))
        host = (g - own + host_strength * prior) / (n - mine + host_strength)
        g, n = paths.get((h, q), (0, 0))
        path = (g - own + path_strength * host) / (n - mine + path_strength)
        assert r["host_posterior"] == pytest.approx(host) and r["path_posterior"] == pytest.approx(path)
        odds = r["evidence"] + math.log(path / (1 - path)) - math.log(prior / (1 - prior))
        assert r["probability"] == pytest.approx(1 / (1 + math.exp(-odds)))
        assert r["kept"] == (r["probability"] >= 0.5)


def test_unread_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string").withColumn("row", F.lit("x"))
    x, y = (r["fingerprint"] for r in fingerprints(df).collect())
    assert x == y
