"""Cheapest edits of a symbol sequence into ``(s?(ua)+)?`` by a run-length min-plus dynamic program.

A row is a symbol: its role initial, and whether it must go or is truncated.
Equal neighbours are one *run*.  A symbol is a 4x4 min-plus matrix over the
states of the target pattern, and a run of ``n`` rows is that matrix to the
power of ``n``, put together from binary powers that each worker caches.  The
products of several stretches of one conversation can be taken apart from each
other, which is how a conversation of any length is spread over tasks.

Costs to go are vectors; less their minimum they take few values, so a row's
choice in a state is looked up once it has been made before.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

# The costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
INF = 1 << 60
# States of the target: nothing yet, system, user, assistant.
STATES = 4
#: The state after a role initial, by state.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state and the role that an edit which chooses the role leads to: user, or assistant after a user.
CHOSEN = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
# Symbols: "-" must go; else the role initial ("?" for any other), upper case where the row is truncated.
GONE, OTHER, OTHER_TRUNCATED = "-", "?", "!"
Vector = tuple[int, int, int, int]


def symbol(initial: str, must_go: bool, truncated: bool) -> str:
    if must_go:
        return GONE
    if initial in ("s", "u", "a"):
        return initial.upper() if truncated else initial
    return OTHER_TRUNCATED if truncated else OTHER


def _edits(sym: str) -> list[list[tuple[str, int, int]]]:
    """By state: the edits of a row, least letter first, as ``(letter, cost, next state)``."""
    out = []
    more = TRUNCATED if sym.isupper() or sym == OTHER_TRUNCATED else 0
    for state in range(STATES):
        edits = [("D", DELETE, state)]
        if sym != GONE:
            kept = AFTER[state].get(sym.lower())
            if kept is not None:
                edits.append(("K", KEEP + more, kept))
            edits.append(("R", REROLE + more, CHOSEN[state][0]))
        out.append(edits)
    return out


_EDITS = {x: _edits(x) for x in "-suaSUA?!"}


def _accept() -> Vector:
    """Costs to go after the last row: inserts up to an accepting state."""
    costs = [0, INF, INF, 0]
    for _ in range(2):
        costs = [min(c, INSERT + costs[CHOSEN[s][0]]) for s, c in enumerate(costs)]
    return tuple(costs)


END: Vector = _accept()


def advance(matrix: tuple[Vector, ...], to_go: Vector) -> Vector:
    """Costs to go ahead of a stretch, from those after it."""
    return tuple(min(m + v for m, v in zip(row, to_go, strict=True)) for row in matrix)


def product(first: tuple[Vector, ...], then: tuple[Vector, ...]) -> tuple[Vector, ...]:
    columns = list(zip(*then, strict=True))
    return tuple(tuple(min(INF, *(x + y for x, y in zip(row, col, strict=True))) for col in columns) for row in first)


IDENTITY = tuple(tuple(0 if s == t else INF for t in range(STATES)) for s in range(STATES))


@lru_cache(maxsize=None)
def power(sym: str, k: int) -> tuple[Vector, ...]:
    """The matrix of ``2**k`` rows of a symbol."""
    if k:
        half = power(sym, k - 1)
        return product(half, half)
    rows = []
    for state in range(STATES):
        costs, now, spent = [INF] * STATES, state, 0
        for _ in range(3):  # none, one or two inserts: a third leads nowhere new
            for _, cost, after in _EDITS[sym][now]:
                costs[after] = min(costs[after], spent + cost)
            now, spent = CHOSEN[now][0], spent + INSERT
        rows.append(tuple(costs))
    return tuple(rows)


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def over_run(sym: str, n: int, to_go: Vector) -> Vector:
    """Costs to go ahead of ``n`` equal rows."""
    k = 0
    while n:
        if n & 1:
            to_go = advance(power(sym, k), to_go)
        n, k = n >> 1, k + 1
    return to_go


def matrix(symbols: str) -> tuple[Vector, ...]:
    """The matrix of a whole stretch."""
    out = IDENTITY
    for sym, n in runs(symbols):
        k = 0
        while n:
            if n & 1:
                out = product(out, power(sym, k))
            n, k = n >> 1, k + 1
    return out


@lru_cache(maxsize=1 << 16)
def _ahead(sym: str, to_go: Vector) -> tuple[Vector, int]:
    """Costs to go ahead of one row, less their minimum, and that minimum."""
    costs = advance(power(sym, 0), to_go)
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(maxsize=1 << 18)
def _choice(sym: str, state: int, to_go: Vector) -> tuple[str, int, int]:
    """Letters up to and with the row's own (least of the cheapest), their cost and the next state."""
    ahead = advance(power(sym, 0), to_go)
    letters, spent = "", 0
    while True:
        best = ahead[state]
        options = [("I", INSERT, None), *_EDITS[sym][state]]
        for letter, cost, after in sorted(options, key=lambda x: x[0]):
            if after is None:
                if INSERT + ahead[CHOSEN[state][0]] == best:
                    letters, spent, state = letters + "I", spent + INSERT, CHOSEN[state][0]
                    break
            elif cost + to_go[after] == best:
                return letters + letter, spent + cost, after


def _less(to_go: Vector) -> Vector:
    least = min(to_go)
    return tuple(c - least for c in to_go)


def unroll(symbols: str, state: int, to_go: Vector) -> tuple[list[str], int, int]:
    """Letters per row, their cost and the state after the stretch, which starts in ``state``.

    Costs to go are advanced run by run through the cached powers; inside a run
    every row's own follow from the row after it.
    """
    spans = runs(symbols)
    after: list[Vector] = [to_go]
    for sym, n in reversed(spans):
        after.append(_less(over_run(sym, n, after[-1])))
    after.pop()
    letters, spent = [], 0
    for sym, n in spans:
        behind = [_less(after.pop())]
        for _ in range(n - 1):
            behind.append(_ahead(sym, behind[-1])[0])
        for row_to_go in reversed(behind):
            text, cost, state = _choice(sym, state, row_to_go)
            letters.append(text)
            spent += cost
    return letters, spent, state


def closing(state: int) -> tuple[str, int]:
    """The inserts after the last row, and their cost."""
    letters = ""
    while END[state]:
        letters, state = letters + "I", CHOSEN[state][0]
    return letters, INSERT * len(letters)


def apply(letters: list[str], rows: list[tuple[str, str]], state: int, last: str = "") -> list[tuple[str, str]]:
    """The repaired ``(role, text)`` rows of a stretch that starts in ``state``; ``last`` are inserts after it."""
    out = []

    def put(role: str, text: str) -> None:
        nonlocal state
        out.append((role, text))
        state = AFTER[state][role[0]]

    for row, text in zip(rows, letters, strict=True):
        for letter in text:
            if letter == "I":
                put(CHOSEN[state][1], "")
            elif letter == "K":
                put(*row)
            elif letter == "R":
                put(CHOSEN[state][1], row[1])
    for _ in last:
        put(CHOSEN[state][1], "")
    return out
