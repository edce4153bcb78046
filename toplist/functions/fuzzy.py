"""Unrestricted Damerau-Levenshtein distance <= 2 as native Spark expressions.

Spark has Levenshtein (with an early-exit threshold) but no transposition
distance.  For the threshold used by search (2 edits, absolute) the test
decomposes exactly into Levenshtein tests on strings one adjacent swap away::

    DL(a, q) <= 2  <=>  lev(a, q) <= 2
                     or lev(a, x) <= 1 for some x in sw(q)
                     or lev(x, q) <= 1 for some x in sw(a)
                     or sw(a) and sw(q) share a string   (two swaps)

where ``sw(s)`` is the set of strings one adjacent transposition away from
``s``.  A transposition of cost 1 with one edit between the swapped pair is
adjacent in one of the two strings, which is why both one-sided terms are
needed.  The last term is the two-swap case: ``a = s2(s1(q))`` with swaps
being involutions means ``s2(a) = s1(q)``.

Everything compiles to built-in expressions (``levenshtein``, ``substring``,
``concat``, ``translate``), so a literal search stays inside whole-stage
codegen.  Cheap necessary conditions run first and reject almost every row:
the length band ``|len(a) - len(q)| <= 2`` and ``lev(a, q) <= 4`` (a
transposition is two Levenshtein edits), evaluated with Spark's banded
early-exit Levenshtein; and the swap terms only run when at most one
character of ``a`` lies outside the characters of ``q`` (a transposition adds
no new character and only one other edit remains).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# Longest literal query whose swap terms are unrolled into the filter; longer
# ones use array lambdas to keep the generated code within JVM method limits.
MAX_UNROLLED_QUERY_LEN = 24


def swaps(s: str) -> set[str]:
    """All strings one adjacent transposition away from ``s`` (driver side)."""
    return {s[:i] + s[i + 1] + s[i] + s[i + 2 :] for i in range(len(s) - 1)}


def swap_at(c: Column, i: Column | int) -> Column:
    """``c`` with the characters at 1-based positions ``i`` and ``i+1`` swapped."""
    if isinstance(i, int):
        i = F.lit(i)
    return F.concat(
        F.substring(c, F.lit(1), i - 1),
        F.substring(c, i + 1, F.lit(1)),
        F.substring(c, i, F.lit(1)),
        F.substring(c, i + 2, F.length(c)),
    )


def swaps_array(c: Column) -> Column:
    """Array of ``c`` with each adjacent pair swapped.

    Strings shorter than two characters yield ``[c]`` itself; the identity is
    harmless in every test below (it only re-admits pairs already within 2).
    """
    upper = F.greatest(F.length(c) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), upper), lambda i: swap_at(c, i))


def _lev_within(a: Column, b: Column | str, k: int) -> Column:
    if isinstance(b, str):
        b = F.lit(b)
    return F.levenshtein(a, b, k) >= 0


def dl_within_literal(c: Column | str, q: str, threshold: int = 2) -> Column:
    """``damerau_levenshtein(c, q) <= threshold`` for a literal query ``q``.

    Only thresholds 0..2 are supported (the search threshold is fixed at 2).
    Null values of ``c`` never match.
    """
    cheap, exact = dl_within_literal_parts(c, q, threshold)
    return cheap & exact


def dl_within_literal_parts(c: Column | str, q: str, threshold: int = 2) -> tuple[Column, Column]:
    """``(cheap, exact)`` with ``cheap & exact`` equal to :func:`dl_within_literal`.

    ``cheap`` is a necessary condition (length band, Levenshtein bound) that
    rejects most rows; conjunctions over several fields should test every
    field's ``cheap`` part before any ``exact`` part.
    """
    if isinstance(c, str):
        c = F.col(c)
    n = len(q)
    length = F.length(c)
    if threshold <= 1:
        # With one edit a transposition is its own case only when it is a pure swap.
        terms = [_lev_within(c, q, threshold)]
        if threshold == 1 and n >= 2:
            terms.append(c.isin(sorted(swaps(q))))
        return length.between(n - threshold, n + threshold), reduce(lambda x, y: x | y, terms)
    if threshold != 2:
        raise ValueError("only thresholds up to 2 are supported")

    sw_q = sorted(swaps(q) - {q})
    sw_sw_q = sorted({y for x in swaps(q) for y in swaps(x)} - {q})
    terms = [_lev_within(c, q, 2)]
    near_len = (length >= n - 1) & (length <= n + 1)
    if n <= MAX_UNROLLED_QUERY_LEN:
        # Unrolled over literals and over the positions a string within one of
        # len(q) can have: no lambda, so the filter stays in whole-stage codegen.
        terms += [_lev_within(c, x, 1) for x in sw_q]
        sw_a = [
            (length >= i + 1) & _lev_within(swap_at(c, i), q, 1)
            for i in range(1, n + 1)
        ]
        if sw_a:
            terms.append(near_len & reduce(lambda x, y: x | y, sw_a))
    else:
        # Long query: array lambdas keep the generated code small (one
        # interpreted filter instead of a method too large to compile).
        if sw_q:
            terms.append(F.exists(F.array(*[F.lit(x) for x in sw_q]), lambda x: _lev_within(c, x, 1)))
        terms.append(near_len & F.exists(swaps_array(c), lambda x: _lev_within(x, q, 1)))
    if sw_sw_q:
        terms.append(c.isin(sw_sw_q))
    prefilter = length.between(n - 2, n + 2) & _lev_within(c, q, 4)
    # Past lev <= 2 a transposition is needed, leaving at most one other edit,
    # so at most one character of c may lie outside q's character set.
    foreign = F.length(F.translate(c, "".join(sorted(set(q))), ""))
    swap_terms = reduce(lambda x, y: x | y, terms[1:]) if len(terms) > 1 else F.lit(False)
    return prefilter, terms[0] | ((foreign <= 1) & swap_terms)


def dl_within2_columns(a: Column, b: Column) -> Column:
    """``damerau_levenshtein(a, b) <= 2`` for two columns (join verification)."""
    la, lb = F.length(a), F.length(b)
    sw_a, sw_b = swaps_array(a), swaps_array(b)
    close = F.abs(la - lb) <= 1
    return (F.abs(la - lb) <= 2) & (
        _lev_within(a, b, 2)
        | (close & F.exists(sw_b, lambda x: _lev_within(a, x, 1)))
        | (close & F.exists(sw_a, lambda x: _lev_within(x, b, 1)))
        | ((la == lb) & F.arrays_overlap(sw_a, sw_b))
    )
