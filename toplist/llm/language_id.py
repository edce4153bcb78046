"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training texts; the regression is
fitted on a bounded sample of them (``per_language`` documents of each language,
the ones with the smallest hashes) with follow-the-regularised-leader steps and
elastic-net penalties, which leave most weights at zero.  A temperature, chosen
on a part of the sample that the fit did not see, calibrates the scores.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toplist.llm.anchors import mix
from toplist.llm.common import stored

# N-gram orders, hash buckets, and the answer for texts without letters.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
UNDETERMINED = "und"
# Documents of a language considered for the sample, as a multiple of its bound.
THINNED = 3


@dataclass(frozen=True)
class Training:
    """Parameters of the fit; ``per_language`` bounds the sample."""

    per_language: int = 1500
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.0001
    calibration_share: int = 5  # every so manieth sampled document calibrates


_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)]))
    return _letters[0][points]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a whole text's n-grams; both empty when it has no letter.

    Lower-cased; every run of other than letters is one space, which also
    stands at both ends.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter(points)
    if not letter.any():
        return np.empty(0, dtype=np.int64), np.empty(0)
    line = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.uint64)
    line = line[np.r_[True, (line[1:] != 32) | (line[:-1] != 32)]]
    total = np.zeros(BUCKETS, dtype=np.int64)
    for order in ORDERS:
        n = len(line) - order + 1
        h = np.full(max(n, 0), order, dtype=np.uint64)
        for i in range(order):
            h = h * np.uint64(0x100000001B3) + line[i : i + n]
        total += np.bincount((mix(h) >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    seen = np.nonzero(total)[0]
    return seen, total[seen].astype(np.float64)


def weighed(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF values (logarithmic term frequency)."""
    x = np.log1p(counts) * idf[buckets]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency of every bucket and, as bucket -1, the number of texts."""
    total, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            buckets, _ = gram_counts(text)
            total[buckets] += 1
            n += len(buckets) > 0
    rows = pa.array(np.arange(-1, BUCKETS), type=pa.int32())
    yield pa.RecordBatch.from_arrays([rows, pa.array(np.r_[n, total])], names=["bucket", "n"])


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for a softmax over classes."""

    def __init__(self, classes: int, p: Training):
        self.p = p
        # The last column is the intercept.
        self.z = np.zeros((classes, BUCKETS + 1))
        self.n = np.zeros((classes, BUCKETS + 1))

    def weights(self, at) -> np.ndarray:
        z, n, p = self.z[:, at], self.n[:, at], self.p
        w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
        return np.where(np.abs(z) <= p.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(w @ x)
        error[label] -= 1
        g = error[:, None] * x
        n = self.n[:, at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha
        self.z[:, at] += g - sigma * w
        self.n[:, at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden-section search over its logarithm.

    Labels are smoothed by one document in all, so a sample without errors
    does not ask for certainty.
    """
    if not len(labels):
        return 1.0
    doubt = 1 / (len(labels) + 2)

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        told = (1 - doubt) * x[np.arange(len(labels)), labels] + doubt * x.mean(axis=1)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - told))

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _trainer(idf: np.ndarray, langs: list[str], p: Training):
    """``applyInArrow`` function over the whole (bounded) sample: weights, and the temperature at bucket -1."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["pick"].to_numpy(), kind="stable")
        texts, labels = table["text"].to_pylist(), table["lang"].to_pylist()
        rows = []
        for i in order:
            buckets, counts = gram_counts(texts[i])
            if len(buckets):
                x = np.append(weighed(buckets, counts, idf), 1.0)
                rows.append((np.append(buckets, BUCKETS), x, langs.index(labels[i])))
        held = rows[:: p.calibration_share] if len(rows) >= 10 * p.calibration_share else []
        fit = [r for i, r in enumerate(rows) if i % p.calibration_share] if held else rows
        model = Ftrl(len(langs), p)
        for epoch in range(p.epochs):
            for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(fit)):
                model.step(*fit[i])
        w = model.weights(slice(None))
        logits = np.array([w[:, at] @ x for at, x, _ in held]).reshape(len(held), len(langs))
        t = best_temperature(logits, np.array([label for _, _, label in held], dtype=np.int64))
        lang, bucket = np.nonzero(w)
        return pa.table(
            {
                "class": pa.array(np.r_[-1, lang], type=pa.int32()),
                "bucket": pa.array(np.r_[-1, bucket], type=pa.int32()),
                "weight": pa.array(np.r_[t, w[lang, bucket]], type=pa.float64()),
            }
        )

    return run


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets, counts = gram_counts(text)
        if not len(buckets) or not self.langs:
            return UNDETERMINED, 0.0
        logits = self.weights[:, buckets] @ weighed(buckets, counts, self.idf) + self.weights[:, -1]
        chances = softmax(logits / self.temperature)
        best = int(chances.argmax())
        return self.langs[best], float(chances[best])


def train(rows: DataFrame, text: Column, lang: Column, pick: Column, p: Training = Training()) -> Model:
    """A model of the languages of ``rows``; rows without text or language are left out.

    ``pick`` (a 64-bit hash of the document) orders the sample.  A language is learned
    from at most ``per_language`` documents, so what one task fits and the
    driver holds is bounded by that and by the number of languages.
    """
    known = rows.select(text.alias("text"), lang.alias("lang"), pick.alias("pick")).where(
        "text is not null and lang is not null"
    )
    counted = known.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket")
    frequency = np.zeros(BUCKETS + 1)
    for r in counted.agg(F.sum("n").alias("n")).collect():  # one row per bucket
        frequency[r["bucket"]] = r["n"]
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1

    # The hash's share of its range thins a language out to a few times the sample before texts are shuffled.
    # One row a language, stored so that the planner sees how few they are and texts meet them where they are read.
    sizes = stored(known.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n")), "language-sizes")
    share = F.col("pick").cast("double") / F.lit(2.0**64) + 0.5
    thinned = known.join(sizes, F.col("lang") == F.col("l")).where(share * F.col("n") < THINNED * p.per_language)
    rank = Window.partitionBy("lang").orderBy("pick", "text")
    sample = stored(
        thinned.select("text", "lang", "pick").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= p.per_language).drop("rank"),
        "language-sample",
    )
    langs = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    weights = np.zeros((len(langs), BUCKETS + 1))
    temperature = 1.0
    if langs:
        fitted = sample.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(_trainer(idf, langs, p), "class int, bucket int, weight double")
        for r in fitted.collect():
            if r["class"] < 0:
                temperature = r["weight"]
            else:
                weights[r["class"], r["bucket"]] = r["weight"]
    return Model(langs, idf, weights, temperature)


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all but the text) with ``lang_pred`` and ``score``.

    Null text and text without a letter give ``und`` with score 0.  Only the
    text enters a prediction.  Carried columns named like the outputs are
    dropped; repeated rows get the same answer.
    """
    carry = [c for c in (carry or docs.columns) if c not in {"lang_pred", "score", text_col}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in carry],
                    pa.array([x for x, _ in found], type=pa.string()),
                    pa.array([x for _, x in found], type=pa.float64()),
                ],
                names=[*carry, "lang_pred", "score"],
            )

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    frame = docs.select(*carry, F.col(text_col).alias("_text"))
    return frame.mapInArrow(run, fields + "lang_pred string, score double")
