"""Name normalisation for search (lower-case, fold to ASCII, strip noise).

Two forms that must agree:

* ``normalize_column`` -- a Column expression used when the index is built,
  made of built-in functions only.  Spark has no Unicode normalisation
  function, but "NFKD, then drop non-ASCII" is a per-code-point map, so it is
  generated once from ``unicodedata`` and applied with ``translate`` (plus a
  map lookup for the few code points that expand to several characters).
* ``normalize_text`` -- the same pipeline on one Python string, used for the
  literal query parameter on the driver.

Steps, in order: lower-case; NFKD then drop every non-ASCII code point;
remove bracketed text (lazy, ``(`` or ``[`` up to the first ``)`` or ``]``);
drop one leading article; whole-word conjunctions and featuring tags become
``&``; delete everything but ``[a-z0-9&]``.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The normalisation patterns.
REGEX_PARENS = r"[\(\[].*?[\)\]]"
REGEX_ARTICLES = r"^(the|a|an|el|la|los|las|un|una)\s+"
REGEX_CONJUNCTIONS = r"\b(and|with|feat|ft|featuring|pres|presents|y|con|e|et)\b"
REGEX_CLEAN = r"[^a-z0-9&]"

#: What happens to a folded name, in order: (pattern, replacement, flags for Java).  Both forms read
#: this table.  Java's ``.`` also stops at ``\r`` unless UNIX_LINES is on; Python's only at ``\n``.
RULES = [
    (REGEX_PARENS, "", "(?d)"),
    (REGEX_ARTICLES, "", ""),
    (REGEX_CONJUNCTIONS, "&", ""),
    (REGEX_CLEAN, "", ""),
]


@functools.cache
def _folds() -> dict[str, str]:
    """What each decomposable non-ASCII character folds to, derived from ``unicodedata`` (the rule itself).

    NFKD only moves combining marks, which are non-ASCII and removed anyway, so
    folding a string equals folding each character and concatenating.
    Characters without a decomposition fold to nothing and are not listed.
    """
    decomposable = (chr(cp) for cp in range(0x80, sys.maxunicode + 1) if unicodedata.decomposition(chr(cp)))
    return {ch: "".join(filter(str.isascii, unicodedata.normalize("NFKD", ch))) for ch in decomposable}


@functools.cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """The one-to-one folds as ``translate`` arguments and the expanding ones as a dict."""
    single = {ch: to for ch, to in _folds().items() if len(to) == 1}
    expand = {ch: to for ch, to in _folds().items() if len(to) > 1}
    return "".join(single), "".join(single.values()), expand


@functools.cache
def _python_rules() -> list[tuple[re.Pattern[str], str]]:
    # re.ASCII makes `\s` and `\b` ASCII-only, as they are in Java on ASCII text.
    return [(re.compile(pattern, re.ASCII), to) for pattern, to, _ in RULES]


def fold_ascii(text: str) -> str:
    """``text`` with every character replaced by its ASCII fold; the same tables as the Column form."""
    return "".join(ch if ch.isascii() else _folds().get(ch, "") for ch in text)


def normalize_text(text: str | None) -> str:
    """Normalise one query string on the driver by :data:`RULES`; ``None``/empty give ``""``."""
    return functools.reduce(
        lambda name, rule: rule[0].sub(rule[1], name), _python_rules(), fold_ascii((text or "").lower())
    )


def _literal_list(values: list[str]) -> Column:
    """An array literal built from one string (one JVM call, not one per element)."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def fold_ascii_column(c: Column) -> Column:
    """Column form of :func:`fold_ascii`, in built-in JVM expressions only.

    Pure-ASCII values (UTF-8 byte length equal to character length) pass
    through.  Otherwise: the rare code points that expand to several ASCII
    characters (ligatures, fractions, squared units...) are replaced through
    a per-character map lookup -- evaluated only for values holding one --
    then ``translate`` applies the one-to-one folds and every remaining
    non-ASCII code point is deleted.  Null stays null.
    """
    src, dst, expand = _fold_tables()
    keys = sorted(expand)
    expand_map = F.map_from_arrays(_literal_list(keys), _literal_list([expand[k] for k in keys]))
    chars = F.regexp_extract_all(c, F.lit("(?s)(.)"), 1)
    expanded = F.array_join(
        F.transform(chars, lambda ch: F.coalesce(F.element_at(expand_map, ch), ch)), ""
    )
    # Detect expanding code points with translate (hashed per character); a
    # 445-code-point regex class is checked linearly per character in Java
    # and made the whole fold about five times slower.
    has_expanding = F.length(F.translate(c, "".join(keys), "")) < F.length(c)
    s = F.when(has_expanding, expanded).otherwise(c)
    s = F.regexp_replace(F.translate(s, src, dst), F.lit(r"[^\x00-\x7F]"), F.lit(""))
    is_ascii = F.octet_length(c) == F.length(c)
    return F.when(is_ascii, c).otherwise(s)


def normalize_column(c: Column | str) -> Column:
    """Column expression equal to :func:`normalize_text` on non-null values."""
    if isinstance(c, str):
        c = F.col(c)
    # The article's pattern is anchored at the start, so replacing all is replacing one.
    return functools.reduce(
        lambda name, rule: F.regexp_replace(name, F.lit(rule[2] + rule[0]), F.lit(rule[1])),
        RULES,
        fold_ascii_column(F.lower(c)),
    )
