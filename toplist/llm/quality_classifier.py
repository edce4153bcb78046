"""Quality classifier by hierarchical empirical Bayes.

Two kinds of evidence meet.  A document's own: the log-likelihood ratios of its
distinct words and word shapes between good and bad labelled documents, counted
over all of them, summed up in a few numbers and put on the scale of log odds
by a small logistic fit.  Its site's: the share of good documents among the
labelled ones of its host and of its path on the host, each shrunk towards the
level above by a beta prior whose strength comes from the spread between
sites, so a site with few labels says what its host says and a sparse host what
the whole corpus says.  The log odds add up, the corpus' prior counted once.

A labelled document is judged without its own label: its words are counted in
one of two folds and it is scored by the other, and it is taken out of its
site's counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toplist.llm.common import stored

# Hash buckets of words and shapes, folds, and pseudo-documents per bucket and class.
BUCKETS = 1 << 17
FOLDS = 2
SMOOTHING = 2.0
# Most damning words looked at on their own.
LOWEST = 4
# Words remembered per worker before the table starts afresh (speed only).
REMEMBERED_WORDS = 500_000
# Bounds of the strength of a beta prior (pseudo-documents).
STRENGTHS = (1.0, 1000.0)
NEWTON_STEPS = 12

FEATURES = ["mean_words", "mean_shapes", "lowest", "one"]


def shape(word: str) -> str:
    """Letters as ``a`` or ``A``, digits as ``0``, runs of one kind once: ``Ab12##`` is ``Aa0#``."""
    out: list[str] = []
    for ch in word:
        kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class _Words(dict):
    """Word to its buckets: the bare lower-cased word's and its shape's."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        bare = word.strip(".,;:!?\"'()").lower()
        found = self[word] = (
            xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) % BUCKETS,
            xxhash.xxh3_64_intdigest(("\0" + shape(word)).encode("utf-8", "surrogatepass")) % BUCKETS,
        )
        return found


_words = _Words()


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets and distinct shape buckets of a whole text."""
    found = [_words[w] for w in set((text or "").split())]
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    both = np.array(found, dtype=np.int64)
    return np.unique(both[:, 0]), np.unique(both[:, 1])


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text's buckets (32-bit numbers, ascending) in place of the text."""
    for batch in batches:
        found = [buckets(t) for t in batch.column("_text").to_pylist()]
        sides = [pa.array([x[i].astype("<i4").tobytes() for x in found], type=pa.binary()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("fold"), *sides], names=["_row", "fold", "words", "shapes"]
        )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by bucket, class and fold; bucket -1 counts the documents themselves."""
    total = np.zeros((2, FOLDS, BUCKETS + 1), dtype=np.int64)
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("words", "shapes", "label", "fold")]
        for words, shapes, label, fold in zip(*columns, strict=True):
            for found in (words, shapes):
                total[label, fold, np.frombuffer(found, dtype="<i4")] += 1
            total[label, fold, -1] += 1
    label, fold, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(bucket == BUCKETS, -1, bucket), type=pa.int32()),
            pa.array(label, type=pa.int32()),
            pa.array(fold, type=pa.int32()),
            pa.array(total[label, fold, bucket], type=pa.int64()),
        ],
        names=["bucket", "label", "fold", "n"],
    )


def likelihood_ratios(labelled: DataFrame) -> np.ndarray:
    """Log-likelihood ratio (good over bad) of every bucket, for each fold left out and, last, for none.

    ``labelled`` has ``words`` and ``shapes`` (buckets), ``label`` (0 or 1) and ``fold``.
    """
    counts = np.zeros((2, FOLDS, BUCKETS + 1))
    grouped = labelled.select("words", "shapes", "label", "fold").mapInArrow(
        _count_batches, "bucket int, label int, fold int, n long"
    ).groupBy("bucket", "label", "fold")
    for r in grouped.agg(F.sum("n").alias("n")).collect():  # bounded by the buckets
        counts[r["label"], r["fold"], r["bucket"]] = r["n"]
    out = np.zeros((FOLDS + 1, BUCKETS))
    for left_out in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left_out]
        seen = counts[:, folds].sum(axis=1)
        chance = (seen[:, :-1] + SMOOTHING / 2) / (seen[:, -1:] + SMOOTHING)
        # A bucket seen in few documents says little: shrink by its count.
        known = seen[:, :-1].sum(axis=0)
        out[left_out] = np.log(chance[1] / chance[0]) * known / (known + SMOOTHING)
    return out.astype(np.float32)


def _features(ratios: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> tuple[float, float, float]:
    x = ratios[words]
    low = np.sort(x)[:LOWEST] if len(x) > LOWEST else x
    return float(x.mean()), float(ratios[shapes].mean()), float(low.sum()) / LOWEST


def _scorer(ratios: np.ndarray):
    """Features of each text by the ratios without its own fold, by all ratios, and whether it has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *found, fold in zip(*[batch.column(c).to_pylist() for c in ("words", "shapes", "fold")], strict=True):
                words, shapes = (np.frombuffer(x, dtype="<i4") for x in found)
                if not len(words):
                    rows.append(((0.0,) * 3, (0.0,) * 3, True))
                    continue
                every = _features(ratios[FOLDS], words, shapes)
                own = every if fold is None else _features(ratios[fold], words, shapes)
                rows.append((own, every, False))
            own, every, blank = list(zip(*rows, strict=True)) or [(), (), ()]
            numbers = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(own, type=numbers), pa.array(every, type=numbers), pa.array(blank, type=pa.bool_())],
                names=["_row", "own", "every", "blank"],
            )

    return run


def logistic_fit(rows: DataFrame, label: Column, penalty: float = 1.0) -> np.ndarray:
    """Coefficients of ``FEATURES`` by Newton steps, each one grouped aggregate over all rows."""
    beta = np.zeros(len(FEATURES))
    x = [F.col(c) for c in FEATURES]
    for _ in range(NEWTON_STEPS):
        z = sum((x[i] * F.lit(float(b)) for i, b in enumerate(beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        g = [F.sum(x[i] * (label - p)) for i in range(len(x))]
        h = [F.sum(x[i] * x[j] * p * (1 - p)) for i in range(len(x)) for j in range(i, len(x))]
        found = [float(v or 0.0) for v in rows.agg(*g, *h).first()]  # one row
        slope = np.array(found[: len(x)]) - penalty * beta
        curve = np.zeros((len(x), len(x)))
        curve[np.triu_indices(len(x))] = found[len(x) :]
        curve = curve + np.triu(curve, 1).T + penalty * np.eye(len(x))
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _strength(mean: Column) -> Column:
    """Prior strength from the spread of the groups' shares about ``mean`` (method of moments)."""
    share = F.col("good") / F.col("n")
    # Between groups of n documents the share varies by m(1-m)/n and what the sites differ by.
    excess = F.sum(F.col("n") * ((share - mean) * (share - mean))) - F.sum(mean * (1 - mean))
    between = excess / F.sum("n")
    spread = F.avg(mean * (1 - mean))
    strength = F.when(between > 0, spread / between - 1).otherwise(F.lit(STRENGTHS[1]))
    return F.least(F.greatest(F.coalesce(strength, F.lit(STRENGTHS[1])), F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))


def site_table(labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (one row), host and path counts with prior strengths; ``labelled`` has host, path, label."""
    paths = stored(
        labelled.groupBy("host", "path").agg(F.sum("label").alias("good"), F.count("*").alias("n")), "quality-paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    # One pseudo-document of each class keeps the share inside (0, 1).
    corpus = hosts.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))
    corpus = stored(corpus, "quality-prior")
    spread = hosts.join(F.broadcast(corpus)).agg(_strength(F.col("prior")).alias("host_strength"))  # one row
    corpus = stored(corpus.join(F.broadcast(spread)), "quality-corpus")
    hosts = stored(
        hosts.join(F.broadcast(corpus)).select(  # one row
            "host",
            F.col("good").alias("host_good"),
            F.col("n").alias("host_n"),
            _shrunk(F.col("good"), F.col("n"), F.col("prior"), F.col("host_strength")).alias("host_share"),
        ),
        "quality-hosts",
    )
    within = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    spread = within.agg(_strength(F.col("host_share")).alias("path_strength"))
    corpus = stored(corpus.join(F.broadcast(spread)), "quality-strengths")  # one row
    return corpus, hosts, paths.withColumnsRenamed({"good": "path_good", "n": "path_n"})


def _shrunk(good: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (good + strength * prior) / (n + strength)


def _log_odds(share: Column) -> Column:
    return F.log(share / (1 - share))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    threshold: float = 0.5,
) -> DataFrame:
    """Per document: ``id_col``, ``evidence``, ``host_posterior``, ``path_posterior``, ``probability``, ``kept``.

    ``labels`` has ``id_col`` and ``label`` (1 good, 0 bad; null labels are left
    out, the smallest counts where an id has several).  A null host or path is a
    site of its own.  Null or empty text has no evidence of its own and gets
    its site's chance.  Without labels every chance is one half.  Repeated rows
    get the same answer each.
    """
    marks = labels.where("label is not null").groupBy(id_col).agg(F.min("label").cast("int").alias("label"))
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"),
        F.col(text_col).alias("text"),
    )
    # Labels grow with the documents, so they are not broadcast while they happen to be few.
    marks = marks.withColumnRenamed(id_col, "id").hint("merge")
    frame = rows.select(F.struct("id", "host", "path").alias("_row"), F.col("text").alias("_text"), fold.alias("fold"))
    row = frame.schema["_row"].dataType.simpleString()
    # Texts are split once and go no further: their buckets are a fraction of them.
    found = stored(
        frame.mapInArrow(_bucket_batches, f"_row {row}, fold int, words binary, shapes binary"), "quality-buckets"
    )
    # Buckets meet labels for the ratios alone; the fold follows from the id, so scoring needs no label.
    by_id = found.select(F.col("_row.id").alias("id"), "fold", "words", "shapes")
    ratios = likelihood_ratios(by_id.join(marks, "id"))
    features = found.mapInArrow(_scorer(ratios), f"_row {row}, own array<double>, every array<double>, blank boolean")
    # A labelled document is judged by the ratios that have not seen it.
    chosen = F.when(F.col("label").isNotNull(), F.col("own")).otherwise(F.col("every"))
    scored = stored(
        stored(features.select("_row.*", "own", "every", "blank"), "quality-features").join(marks, "id", "left").select(
            "id", "host", "path", "label", "blank", *[chosen[i].alias(c) for i, c in enumerate(FEATURES[:-1])],
            F.lit(1.0).alias("one"),
        ),
        "quality-scored",
    )
    labelled = scored.where("label is not null")
    beta = logistic_fit(labelled, F.col("label"))
    corpus, hosts, paths = site_table(labelled.select("host", "path", "label"))

    fit = sum((F.col(c) * F.lit(float(b)) for c, b in zip(FEATURES, beta, strict=True)), F.lit(0.0))
    sites = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    sites = stored(sites.withColumnsRenamed({"host": "p_host", "path": "p_path"}), "quality-sites")
    joined = (
        scored.join(
            sites, F.col("host").eqNullSafe(F.col("p_host")) & F.col("path").eqNullSafe(F.col("p_path")), "left"
        )
        .drop("host_good", "host_n", "host_share")
        .join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left")
        .join(F.broadcast(corpus))  # one row
    )
    # A labelled document is taken out of its site's counts.
    own, mine = F.coalesce(F.col("label"), F.lit(0)), F.col("label").isNotNull().cast("int")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = joined.withColumn(
        "host_posterior",
        _shrunk(count("host_good") - own, count("host_n") - mine, F.col("prior"), F.col("host_strength")),
    ).withColumn(
        "path_posterior",
        _shrunk(count("path_good") - own, count("path_n") - mine, F.col("host_posterior"), F.col("path_strength")),
    )
    odds = F.col("evidence") + _log_odds(F.col("path_posterior")) - _log_odds(F.col("prior"))
    return (
        joined.withColumn("evidence", F.when(F.col("blank"), _log_odds(F.col("prior"))).otherwise(fit))
        .withColumn("probability", 1 / (1 + F.exp(-odds)))
        .select(
            F.col("id").alias(id_col), "evidence", "host_posterior", "path_posterior", "probability",
            (F.col("probability") >= threshold).alias("kept"),
        )
    )
