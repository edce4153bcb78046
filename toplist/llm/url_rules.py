"""URL filters: a trie over reversed host labels and path segments, longest rule first.

A rule is a host and a path; it fits the host and all its subdomains where the
URL's path starts with the rule's.  The trie walks the host's labels from the
last to the first, then the path's segments; every rule that fits ends on that
walk, and the deepest host label wins, then the longest path.  The trie is
broadcast while it has at most ``MAX_TRIE_RULES`` rules; a longer list is a
table that URLs meet by joins on the same walk (:func:`judge_by_joins`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toplist.llm.common import stored

# Rules a broadcast trie may hold.
MAX_TRIE_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class _Path:
    below: dict[str, _Path] = field(default_factory=dict)
    # Rules that end inside a segment of this node: (beginning of the segment, rule), longest first.
    ends: list[tuple[str, Rule]] = field(default_factory=list)


@dataclass
class _Host:
    below: dict[str, _Host] = field(default_factory=dict)
    paths: _Path | None = None


class Trie:
    """Rules by reversed host labels, then path segments."""

    def __init__(self, rules: list[Rule]):
        self.root = _Host()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, _Host())
            node.paths = node.paths or _Path()
            *whole, last = rule.path.split("/")
            at = node.paths
            for segment in whole:
                at = at.below.setdefault(segment, _Path())
            if rule.text not in {r.text for p, r in at.ends if p == last}:
                at.ends.append((last, rule))
                at.ends.sort(key=lambda x: -len(x[0]))

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits."""
        fitting, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths is not None:
                fitting.append(node.paths)
        segments = path.split("/")
        for paths in reversed(fitting):
            found, at = None, paths
            for segment in segments:
                found = next((r for p, r in at.ends if segment.startswith(p)), found)
                at = at.below.get(segment)
                if at is None:
                    break
            if found is not None:
                return found
        return None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end; the path what follows up to ``?``, ``#`` or the end.
    """
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _in_order(rules: list[Rule]) -> list[Rule]:
    """One rule per host and path; a block entry stands before an allow entry for the same place."""
    return sorted(dict.fromkeys(rules), key=lambda r: (r.host, r.path, r.verdict != "block"))


def _finder(rules: list[Rule]):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie(rules)
        for hosts, paths in batches:
            found = [trie.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(
                {"rule": [r and r.text for r in found], "verdict": [r and r.verdict for r in found]}
            )

    return run


def judge_urls(
    pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow",
    max_trie_rules: int = MAX_TRIE_RULES,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (text of the winning rule or null) and ``verdict``.

    A URL that no rule fits gets ``default``; so does null, empty or
    scheme-less text, whose host and path are empty.  Of an allow and a block
    rule for the same host and path the block rule counts.  Input columns named
    like the outputs are replaced; repeated rows are judged alike.
    """
    rules = _in_order(rules)
    host, path = host_and_path(F.col(url_col))
    base = pages.withColumns({"_host": host, "_path": path}).drop("host", "path", "rule", "verdict")
    if len(rules) > max_trie_rules:
        return judge_by_joins(base, rules, default)
    find = F.pandas_udf(_finder(rules), "rule string, verdict string")
    judged = base.withColumn("_found", find("_host", "_path"))
    return _named(judged, F.col("_found.rule"), F.col("_found.verdict"), default).drop("_found")


def _named(df: DataFrame, rule: Column, verdict: Column, default: str) -> DataFrame:
    return (
        df.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.lit(default))})
        .withColumnsRenamed({"_host": "host", "_path": "path"})
    )


def judge_by_joins(base: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same judgement by joins, for rule lists too long to broadcast.

    Distinct host and path pairs are exploded into the steps of their walk
    (host suffixes; whole path segments so far) and meet the rules that end
    below such a step; what is left of the rule is checked as a prefix.
    """
    spark = base.sparkSession
    table = spark.createDataFrame(
        [(r.host, r.path.rpartition("/")[0], r.path, r.verdict) for r in rules],
        "r_host string, r_stem string, r_path string, r_verdict string",
    )
    table = stored(table, "url-rules")
    pairs = base.select("_host", "_path").distinct()
    labels, segments = F.split("_host", r"\."), F.split("_path", "/")
    steps = pairs.withColumn(
        "r_host",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
            )
        ),
    ).withColumn(
        "r_stem",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.array_join(F.slice(segments, 1, i), "/")
            )
        ),
    )
    depth = F.size(F.split("r_host", r"\."))
    best = (
        steps.distinct()
        .join(table, ["r_host", "r_stem"])
        .where(F.startswith("_path", F.col("r_path")))
        .groupBy("_host", "_path")
        .agg(
            F.max(
                F.struct(
                    depth.alias("d"), F.length("r_path").alias("n"), (F.col("r_verdict") == "block").alias("b"),
                    F.concat("r_host", "r_path").alias("text"), F.col("r_verdict").alias("verdict"),
                )
            ).alias("_best")
        )
    )
    judged = base.join(best, ["_host", "_path"], "left")
    return _named(judged, F.col("_best.text"), F.col("_best.verdict"), default).drop("_best")
