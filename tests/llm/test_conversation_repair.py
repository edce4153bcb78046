"""Conversation repair against exhaustive search on short sequences and plain dynamic programming on long ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from toplist.llm import run_length as dp
from toplist.llm.conversation_repair import damage, repair, summary

SCHEMA = "conv_id long, turn long, role string, text string, conv string, rows string, kind string, block string"
GAPS = " \t\n\x0b\x0c\r"
TARGET = re.compile("(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "r", "k", "b") for r in rows], SCHEMA)


def exhaustive(rows):
    """Cheapest edits of (initial, must_go, truncated) rows by trying all; up to two inserts between rows."""
    inserts = [""] + ["u", "a", "ua", "au", "uu", "aa"]
    per_row = []
    for initial, must_go, truncated in rows:
        edits = [("D", 4, "")]
        if not must_go:
            more = 3 * truncated
            edits += [("K", more, initial), ("R", 3 + more, "u"), ("R", 3 + more, "a")]
        per_row.append(edits)
    best = None
    for before in itertools.product(inserts, repeat=len(rows) + 1):
        extra = 3 * sum(map(len, before))
        if best is not None and extra > best[0]:
            continue
        for edits in itertools.product(*per_row):
            cost = extra + sum(e[1] for e in edits)
            if best is not None and cost > best[0]:
                continue
            shape = "".join(b + e[2] for b, e in zip(before, edits, strict=False)) + before[-1]
            if TARGET.fullmatch(shape):
                audit = "".join("I" * len(b) + e[0] for b, e in zip(before, edits, strict=False)) + "I" * len(before[-1])
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def plain(rows):
    """Cheapest cost, least audit and the result's (role, source row) by a row-at-a-time program over whole strings."""
    step = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    role = ["u", "u", "a", "u"]
    inf = (10**9, "", ())

    def with_inserts(ends):
        out = list(ends)
        for _ in range(3):
            out = [min(out[s], (3 + out[step[s][role[s]]][0], "I" + out[step[s][role[s]]][1], ((role[s], None),) + out[step[s][role[s]]][2]),
                       key=lambda x: x[:2]) for s in range(4)]
        return out

    best = with_inserts([(0, "", ()), inf, inf, (0, "", ())])
    for i in range(len(rows) - 1, -1, -1):
        initial, must_go, truncated = rows[i]
        ahead = []
        for s in range(4):
            options = [(4 + best[s][0], "D" + best[s][1], best[s][2])]
            if not must_go:
                if initial in step[s]:
                    b = best[step[s][initial]]
                    options.append((3 * truncated + b[0], "K" + b[1], ((initial, i),) + b[2]))
                b = best[step[s][role[s]]]
                options.append((3 + 3 * truncated + b[0], "R" + b[1], ((role[s], i),) + b[2]))
            ahead.append(min(options, key=lambda x: x[:2]))
        best = with_inserts(ahead)
    return best[0]


def expected(rows):
    """The query's columns in plain Python over (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        out = convs.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    answer = []
    for conv, given in convs.items():
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in given:
            bare = text.strip(GAPS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in given if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(given, given[1:], strict=False))
        cost, audit, result = plain(symbols)
        full = {"u": "user", "a": "assistant"}
        lines = []
        for initial, i in result:
            kept = i is not None and given[i][1][:1] == initial
            lines.append((given[i][1] if kept else full[initial]) + ":" + ("" if i is None else given[i][2]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        answer.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(answer, key=repr)


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def query(df, **sizes):
    return summary(repair(damage(df), F.col("present"), **sizes))


KINDS = [(i, g, t) for i in "suax" for g, t in ((False, False), (False, True))] + [("u", True, False)]


def test_plain_program_is_exhaustive_search():
    for n in range(4):
        rng = random.Random(n)
        sequences = list(itertools.product(KINDS, repeat=n))
        for rows in sequences if n < 2 else rng.sample(sequences, 12 if n == 2 else 5):
            assert plain(list(rows))[:2] == exhaustive(list(rows))


def test_run_length_program_is_plain_program():
    rng = random.Random(8)
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 200]:
        for _ in range(60):
            rows = []
            while len(rows) < n:
                rows += [rng.choice(KINDS)] * rng.choice([1, 1, 1, 2, 5, 17])
            rows = rows[:n]
            symbols = "".join(dp.symbol(*r) for r in rows)
            cost, audit, _ = plain(rows)
            letters, spent, state = dp.unroll(symbols, 0, dp.END)
            last, more = dp.closing(state)
            assert (spent + more, "".join(letters) + last) == (cost, audit)
            assert dp.advance(dp.matrix(symbols), dp.END)[0] == cost
            if n:
                cut = rng.randrange(n)
                both = dp.product(dp.matrix(symbols[:cut]), dp.matrix(symbols[cut:]))
                assert both == dp.matrix(symbols)


def conversations(rng, convs, longest):
    texts = ["Yes.", "No!", "Why?", "because", "", " \n", "Yes.", "a longer text. it ends", "漢字。", "ends ok.\t", "x" * 50 + "."]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usher"])
            text = rng.choice(texts) if rng.random() < 0.7 else f"turn {t} of {rng.random()}."
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, t // 2, t + 3]), role, text))
    return rows


@pytest.mark.parametrize("part_rows", [10_000, 3])
def test_whole_query(spark, part_rows):
    rng = random.Random(part_rows)
    rows = conversations(rng, 60, 12) + conversations(rng, 3, 150)
    # Nulls anywhere, repeated rows, a conversation that loses all its rows.
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (900, None, "user", "Hi."), (901, 1, None, "Hi.")]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Hi."), (902, 5, "assistant", "z" * 300_000 + "."), (902, 4, "user", "y " * 100_000)]
    rng.shuffle(rows)
    answer = got(query(frame(spark, rows).repartition(5), part_rows=part_rows))
    assert answer == expected(rows)
    assert next(r for r in answer if r[0] == gone) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_and_empty_table(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Turn {t}.", "cut"])) for t in range(3000)]
    rows += [(8, t, "user", "Same.") for t in range(500)]
    assert got(query(frame(spark, rows), part_rows=100)) == expected(rows)
    assert got(query(frame(spark, []))) == []


def test_repaired_rows_have_the_target_shape(spark):
    rows = conversations(random.Random(2), 40, 10)
    parts = repair(damage(frame(spark, rows)), F.col("present")).collect()
    by_conv = {}
    for p in sorted(parts, key=lambda p: (p["conv"], p["block"], p["seq"])):
        by_conv.setdefault(p["conv"], []).extend(r["role"][:1] for r in p["rows"])
    assert len(by_conv) == len({r[0] for r in rows})
    assert all(TARGET.fullmatch("".join(x)) for x in by_conv.values())
