import random

import pytest
from pyspark.sql import functions as F

from toplist.functions.fuzzy import dl_within2_columns, dl_within_literal, swaps


def dl(a: str, b: str) -> int:
    """Textbook unrestricted Damerau-Levenshtein (Lowrance-Wagner)."""
    inf = len(a) + len(b)
    d = [[0] * (len(b) + 2) for _ in range(len(a) + 2)]
    d[0][0] = inf
    for i in range(len(a) + 1):
        d[i + 1][0] = inf
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[0][j + 1] = inf
        d[1][j + 1] = j
    last = {}
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, l_ = last.get(b[j - 1], 0), db
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            d[i + 1][j + 1] = min(
                d[i][j] + cost,
                d[i + 1][j] + 1,
                d[i][j + 1] + 1,
                d[k][l_] + (i - k - 1) + 1 + (j - l_ - 1),
            )
        last[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


def test_reference_distance_examples():
    assert dl("ca", "abc") == 2  # unrestricted, not OSA (3)
    assert dl("leapartst", "leapartist") == 1
    assert dl("", "ab") == 2


def mutations(q: str, rng: random.Random, alphabet: str) -> list[str]:
    out = []
    for _ in range(40):
        s = list(q)
        for _ in range(rng.randint(1, 3)):
            op = rng.randint(0, 3)
            pos = rng.randint(0, max(len(s) - 1, 0))
            if op == 0 and s:
                s[pos] = rng.choice(alphabet)
            elif op == 1:
                s.insert(pos, rng.choice(alphabet))
            elif op == 2 and s:
                del s[pos]
            elif op == 3 and len(s) >= 2 and pos < len(s) - 1:
                s[pos], s[pos + 1] = s[pos + 1], s[pos]
        out.append("".join(s))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_literal_predicate_matches_textbook(spark, seed):
    rng = random.Random(seed)
    alphabet = "abc"
    queries = ["", "a", "ab", "ca", "abc", "abca", "bcab", "aabbc", "abcabca"]
    names = {"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(500)}
    for q in queries:
        names.update(mutations(q, rng, alphabet))
    df = spark.createDataFrame([(n,) for n in sorted(names)] + [(None,)], "name string").cache()
    for q in queries:
        got = {r["name"] for r in df.where(dl_within_literal("name", q)).collect()}
        want = {n for n in names if dl(n, q) <= 2}
        assert got == want, q


def test_long_literal_query_uses_lambda_form(spark):
    rng = random.Random(4)
    q = "".join(rng.choice("abcd") for _ in range(30))
    names = set(mutations(q, rng, "abcd")) | {q, q[::-1], q[1:], q + "ab"}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    got = {r["name"] for r in df.where(dl_within_literal("name", q)).collect()}
    assert got == {n for n in names if dl(n, q) <= 2}


def test_literal_thresholds_0_and_1(spark):
    names = ["abc", "acb", "ab", "abcd", "xbc", "cab", "bca"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for k in (0, 1):
        got = {r["name"] for r in df.where(dl_within_literal("name", "abc", k)).collect()}
        assert got == {n for n in names if dl(n, "abc") <= k}


def test_column_predicate_matches_textbook(spark):
    rng = random.Random(11)
    alphabet = "abcd"
    strings = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(120)]
    pairs = [(a, b) for a in strings[:60] for b in strings[60:]]
    pairs += [(a, m) for a in strings[:20] for m in mutations(a, rng, alphabet)[:10]]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {
        (r["a"], r["b"])
        for r in df.where(dl_within2_columns(F.col("a"), F.col("b"))).collect()
    }
    want = {(a, b) for a, b in pairs if dl(a, b) <= 2}
    assert got == want


def test_swaps():
    assert swaps("abc") == {"bac", "acb"}
    assert swaps("a") == set()
