"""Quality rules, mixing, URL rules and fingerprints against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from toplist.llm.fingerprints import edited_fingerprints, fingerprints
from toplist.llm.mixing import mix_sources
from toplist.llm.quality_rules import Limits, js_distance, quality_rules
from toplist.llm.url_rules import Rule, judge_urls

DOCS = "doc_id long, text string, lang string, source string, kept string, size string, _row string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


def base_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            covered |= set(range(k, k + 8))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeated, len(covered), failed)


def prose(rng, n):
    common = ["the", "of", "and", "to", "in", "is", "a", "that"]
    return " ".join(rng.choice(common) if rng.random() < 0.45 else rng.choice("bcdfgh") + "ord" * rng.randrange(1, 3) for _ in range(n))


QUALITY_TEXTS = [
    None, "", " \n\t", "a b c d e f g h i", "one two three four five six seven eight " * 2,
    "x\ny\nx\n\n \n \nx", "\x0b\x0cform feed\r\nline", "# * $ % & | < > é 🙂", "same " * 40, "w" * 50000,
    "a b c d e f g h " * 3 + " ".join(f"u{i}" for i in range(60)) + " a b c d e f g h",
]


def test_base_counts(spark):
    rng = random.Random(1)
    texts = QUALITY_TEXTS + ["\n".join(prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 8))) for _ in range(30)]
    rows = quality_rules(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == base_counts(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"]) and r["size"] == "y"


def test_divergence_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, rng.randrange(40, 300)) + ".", "en", "s") for i in range(60)]
    junk = [(100 + i, " ".join(f"{w.upper()}&&&" for w in prose(rng, 100).split()), "en", "s") for i in range(3)]
    short = [(200, "UPPER CASE ONLY " + "Q " * 20, "en", "s")]
    rows = {r["doc_id"]: r for r in quality_rules(frame(spark, good + junk + short)).collect()}
    assert all(rows[i]["kept"] for i, *_ in good)
    assert not any(rows[i]["kept"] for i, *_ in junk)
    assert rows[200]["class_distance"] is None  # below the minimum length


def test_texts_without_common_words_are_rejected(spark):
    # 40 words with 27 % of all words, as in the given tables: no text reaches a distance of 0.40 by their lack.
    rng = random.Random(6)

    def text(tongue, n=150):
        return " ".join(
            f"{tongue}{rng.randrange(40)}" if rng.random() < 0.27 else "".join(rng.choices("aeiorstln", k=8)) for _ in range(n)
        )

    good = [(i, text("ab"[i % 2]), "ab"[i % 2], "s") for i in range(200)]
    gibberish = [(300 + i, " ".join("".join(rng.choices("aeiorstln", k=8)) for _ in range(150)), "a", "s") for i in range(4)]
    other = [(400 + i, text("b"), "a", "s") for i in range(4)]
    short = [(500, " ".join("".join(rng.choices("aeiorstln", k=8)) for _ in range(50)), "a", "s")]
    found = {r["doc_id"]: r for r in quality_rules(frame(spark, good + gibberish + other + short)).collect()}
    assert all(found[i]["kept"] for i, *_ in good + short)
    for i, *_ in gibberish + other:
        assert found[i]["word_distance"] < 0.40 and found[i]["class_distance"] < 0.20 and not found[i]["base_failed"]
        assert not found[i]["kept"]


def test_common_words_may_be_long(spark):
    rng = random.Random(5)
    usual = ["gewoonlijk" + c for c in "abcdefghijklmnopqrst"]
    good = [(i, " ".join(rng.choices(usual, k=100)), "nl", "s") for i in range(30)]
    other = (99, " ".join("".join(rng.choices("abcdefghijklm", k=11)) for _ in range(100)), "nl", "s")
    found = {r["doc_id"]: r for r in quality_rules(frame(spark, [*good, other])).collect()}
    assert all(found[i]["kept"] and found[i]["word_distance"] < 0.3 for i in range(30))
    assert found[99]["word_distance"] > 0.4 and not found[99]["kept"] and not found[99]["base_failed"]


def test_quality_of_empty_table_and_filter(spark):
    assert quality_rules(frame(spark, [])).collect() == []
    rng = random.Random(3)
    kept = quality_rules(frame(spark, [(i, prose(rng, 80), "en", "s") for i in range(5)]), Limits(max_word_distance=1.0)).where("kept")
    assert kept.count() == 5


def test_js_distance(spark):
    row = spark.range(1).select(
        js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"),
        js_distance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("same"),
        js_distance(F.lit(None).cast("array<double>"), F.array(F.lit(0.5))).alias("none"),
    ).first()
    assert row["far"] == pytest.approx(1) and row["same"] == 0 and row["none"] is None


def targets(sizes, weights, epochs=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        weight = sum(w[s] for s in names if s not in capped)
        out = {s: epochs * sizes[s] if s in capped else rest * w[s] / weight for s in names}
        above = {s for s in names if s not in capped and out[s] > epochs * sizes[s]}
        if not above:
            return out
        capped |= above


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_reaches_targets(spark, seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in (("b", 300), ("a", 3), ("c", 40), (None, 20), ("é", 0), ("d", 200)):
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rng.randrange(1, 400)) if rng.random() < 0.95 else None, "en", source))
            i += 1
    rows.append((i, "", "en", "empty"))
    found = mix_sources(frame(spark, rows), [5, 2, 1]).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want = targets(dict(sizes), [5, 2, 1])
    taken = Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(0.02 * target, 40), source
    again = mix_sources(frame(spark, rows).repartition(5), [5, 2, 1]).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in found}


def test_mix_prefers_quality(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(400)] + [(1000 + i, "w " * 10, "en", "b") for i in range(400)]
    found = mix_sources(frame(spark, rows), [1, 3], quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).collect()
    a = [r for r in found if r["source"] == "a" and r["copies"]]
    assert sum(r["doc_id"] % 2 == 0 for r in a) > 0.6 * len(a)


def test_mix_odd_tables(spark):
    assert mix_sources(frame(spark, []), [5, 2, 1]).collect() == []
    same = [(None, "a b", "x", "s"), (None, "a b", "x", "s"), (1, None, None, None)]
    found = mix_sources(frame(spark, same), [5]).collect()
    assert sorted((r["size"], r["taken"]) for r in found) == [(0, 0), (2, 2), (2, 2)]


RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"), Rule("block", "a.b.com", ""), Rule("allow", "a.b.com", ""),
]
URLS = [
    None, "", "no scheme", "http://", "https://X.Example.ORG/es/1", "http://example.org/es", "http://example.org/en/12/x?y#z",
    "http://example.org/en/2", "http://org", "http://org/", "http://notexample.org/es/", "http://w.com/fr/1", "http://w.com/fr",
    "http://w.com/de/", "http://a.b.com", "http://q.a.b.com/de/", "ftp://h.com?x=/de/", "http://u@com/de/", "http://com//de/",
    "http://one.com/://two.com/de/", "http://com:80/de/", "http://.com/de/", "x\n://com/de/\n?q",
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("(?s)[^/?#]*", rest)[0]
        path = re.match("(?s)[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


@pytest.mark.parametrize("most", [200_000, 3])
def test_urls(spark, most):
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string")
    for r in judge_urls(df, RULES, max_trie_rules=most).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(URLS[r["page_id"]]), URLS[r["page_id"]]
    assert judge_urls(df.limit(0), RULES, max_trie_rules=most).collect() == []


def similarity(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark):
    rng = random.Random(4)
    texts = {i: prose(rng, rng.randrange(5, 300)) for i in range(80)}
    texts |= {80: "", 81: None, 82: texts[3], 83: "é🙂" * 30, 84: "a"}
    rows = [(i, t, "", "") for i, t in texts.items()] + [(84, "a", "", ""), (None, "no id here", "", "")]
    found = {r["doc_id"]: r for r in edited_fingerprints(frame(spark, rows).repartition(4)).collect()}
    assert len(found) == len(texts) + 1
    order = [*sorted(texts, reverse=True), None]
    whole = texts | {None: "no id here"}
    near = []
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        text, after = whole[i] or "", whole[following] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = found[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        near += [r["near_edited"], r["near_next"]]
    assert found[3]["fingerprint"] == found[82]["fingerprint"] and found[80]["fingerprint"] == found[81]["fingerprint"]
    assert all(0 <= n <= 1 for n in near)
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints(frame(spark, rows)).collect()}
    assert all(plain[i] == found[i]["fingerprint"] for i in texts)
    assert edited_fingerprints(frame(spark, [])).collect() == []


def test_fingerprints_estimate_generalised_jaccard(spark):
    # Words of their own for every text, so that the draws of different texts are independent.
    rng = random.Random(5)
    texts = {i: " ".join(f"{i}.{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(20, 200))) for i in range(150)}
    found = {r["doc_id"]: r for r in edited_fingerprints(frame(spark, [(i, t, "", "") for i, t in texts.items()])).collect()}
    errors = []
    for i, text in texts.items():
        after, third = texts[(i - 1) % len(texts)], len(text) // 3
        errors.append(found[i]["near_edited"] - similarity(text, text[: len(text) - third] + after[:third]))
        assert found[i]["near_next"] == 0
    assert sum(errors) / len(errors) == pytest.approx(0, abs=0.035)
    # The spread is the binomial one of the samples.
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.16
