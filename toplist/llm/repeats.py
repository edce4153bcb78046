"""Repeated byte passages by depth-limited radix passes over suffixes.

A byte is repeated when a ``window``-byte string that covers it also starts
somewhere else, in the same text or another.  Suffixes only matter through
their first ``window`` bytes, so the sort stops at that depth, and groups with
one member are dropped after every pass (most significant digit first):

1. Windows are keyed at their anchor (see :mod:`toplist.llm.anchors`), one row
   for all the windows of a text that share it.  The first digit is the
   ``gram`` bytes at the anchor: anchors whose gram occurs once in the corpus
   are finished, and with them all their windows.
2. The second digit is everything any window of the anchor can reach.  Anchors
   that agree on it with another are repeated to the full, without looking at
   single windows.
3. What is left (anchors at the edges of repeats) is split window by window,
   together with one anchor of every other reach of the same gram: their
   windows are grouped by their exact bytes' hash; groups of two or more are
   the repeated windows.  A gram with
   more edge anchors than ``GROUP_ROWS`` is grouped by Spark, one row per
   window; the others are grouped inside tasks, many grams to a batch.

Hashes are pairs of 64-bit values (gram and window), 128 bits for each
comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplist.llm.anchors import Prefix, anchors, mix, window_hashes
from toplist.llm.common import stored

# Bytes of the first digit and anchors of one gram grouped inside a task.
GRAM = 64
GROUP_ROWS = 8_192
# Rows of a batch of edge anchors (about 340 bytes each).
BATCH_ROWS = 8_192


def _anchor_lists(window: int):
    """``_key, _text`` to ``_key, n_bytes, at, gram, reach`` (lists by anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach_left = window - GRAM
        for batch in batches:
            at, gram, reach, sizes = [], [], [], []
            for text in batch.column("_text"):
                data = np.frombuffer(text.as_py() or b"", dtype=np.uint8)
                sizes.append(len(data))
                where, prefix = anchors(data, window, GRAM)
                at.append(where)
                if prefix is None:
                    gram.append(where)
                    reach.append(where)
                    continue
                left = np.maximum(where - reach_left, 0)
                right = np.minimum(where + window, len(data))
                gram.append(prefix.ranges(where, where + GRAM).view(np.int64))
                # The anchor's place inside its reach is part of the digit.
                whole = prefix.ranges(left, right) + (where - left).astype(np.uint64)
                reach.append(mix(whole).view(np.int64))
            offsets = np.zeros(len(at) + 1, dtype=np.int32)
            np.cumsum([len(a) for a in at], out=offsets[1:])
            lists = [
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x).astype(kind)))
                for x, kind in ((at, np.int32), (gram, np.int64), (reach, np.int64))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(sizes, type=pa.int64()), *lists],
                names=["_key", "n_bytes", "at", "gram", "reach"],
            )

    return run


def _edge_contexts(window: int):
    """``_key, _text, edge`` (positions) to one row per edge anchor with the bytes around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach_left = window - GRAM
        for batch in batches:
            keys, ats, lefts, context, grams = [], [], [], [], []
            for key, text, edge in zip(
                batch.column("doc"), batch.column("_text"), batch.column("edge"), strict=True
            ):
                data = text.as_py()
                for at in edge.values.to_numpy(zero_copy_only=False):
                    left = max(int(at) - reach_left, 0)
                    keys.append(key.as_py())
                    ats.append(int(at))
                    lefts.append(int(at) - left)
                    context.append(data[left : int(at) + window])
                    grams.append(data[int(at) : int(at) + GRAM])
            hashed = np.empty(0, dtype=np.int64)
            if grams:
                rows = np.frombuffer(b"".join(grams), dtype=np.uint8)
                starts = np.arange(len(grams), dtype=np.int64) * GRAM
                hashed = Prefix(rows).ranges(starts, starts + GRAM).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashed, type=pa.int64()),
                    pa.array(keys, type=pa.int64()),
                    pa.array(ats, type=pa.int32()),
                    pa.array(lefts, type=pa.int32()),
                    pa.array(context, type=pa.binary()),
                ],
                names=["gram", "doc", "at", "left", "context"],
            )

    return run


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of True in a 2-d mask."""
    edges = np.zeros((flags.shape[0], flags.shape[1] + 2), dtype=np.int8)
    edges[:, 1:-1] = flags
    step = np.diff(edges, axis=1)
    row, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    return row, first, after - 1


def _repeated_ranges(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Byte ranges of the repeated windows among edge anchors that hold all rows of their grams."""
    hashes, valid = window_hashes(rows["context"].to_numpy(), rows["left"].to_numpy(), window, window - GRAM)
    group = mix(rows["gram"].to_numpy().view(np.uint64))
    flags = np.zeros(valid.shape, dtype=bool)
    for d in range(valid.shape[1]):
        here = np.nonzero(valid[:, d])[0]
        both = np.stack([group[here], hashes[here, d]], axis=1)
        order = np.lexsort((both[:, 1], both[:, 0]))
        same = np.all(both[order][1:] == both[order][:-1], axis=1)
        hit = np.zeros(len(here), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        flags[here[order[hit]], d] = True
    row, first, last = _runs(flags)
    at = rows["at"].to_numpy()[row].astype(np.int64)
    # Column d is the window that starts d bytes ahead of the anchor.
    return pd.DataFrame({"doc": rows["doc"].to_numpy()[row], "start": at - last, "end": at - first + window})


def _grouped(window: int):
    """``mapInPandas`` over rows sorted by gram: whole grams are kept together across batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < BATCH_ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = int(np.searchsorted(rows["gram"].to_numpy(), rows["gram"].iloc[-1]))
            if last:
                yield _repeated_ranges(rows.iloc[:last].reset_index(drop=True), window)
            held = [rows.iloc[last:]]
        if held:
            yield _repeated_ranges(pd.concat(held, ignore_index=True), window)

    return run


def _window_rows(window: int):
    """One row per window of the edge anchors: ``gram, hash, doc, start``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            hashes, valid = window_hashes(
                rows["context"].to_numpy(), rows["left"].to_numpy(), window, window - GRAM
            )
            row, d = np.nonzero(valid)
            yield pd.DataFrame(
                {
                    "gram": rows["gram"].to_numpy()[row],
                    "hash": (hashes[row, d] + d.astype(np.uint64)).view(np.int64),
                    "doc": rows["doc"].to_numpy()[row],
                    "start": rows["at"].to_numpy()[row].astype(np.int64) - d,
                }
            )

    return run


def repeated_ranges(docs: DataFrame, text_col: str = "text", window: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``text_md5`` (binary), ``start``, ``end``: byte ranges covered by repeated windows, per distinct text.

    Ranges may overlap; :func:`without_repeats` merges them.  Null and empty
    texts and texts shorter than a window have none.  Every byte of a text that
    occurs twice and is at least a window long is repeated.
    """
    text = F.col(text_col)
    texts = docs.where(F.octet_length(text) >= window).select(
        F.unhex(F.md5(text.cast("binary"))).alias("_key"), text.cast("binary").alias("_text")
    )
    lists = stored(
        texts.mapInArrow(
            _anchor_lists(window),
            "_key binary, n_bytes long, at array<int>, gram array<long>, reach array<long>",
        ).withColumn("doc", F.monotonically_increasing_id()),
        "repeats-anchors",
    )
    rows = lists.select("doc", F.explode(F.arrays_zip("at", "gram", "reach")).alias("x")).select(
        "doc", "x.at", "x.gram", "x.reach"
    )
    again = rows.groupBy("gram").count().where("count > 1").select("gram")
    left = stored(rows.join(again, "gram"), "repeats-left")
    reached = stored(
        left.groupBy("gram", "reach").agg(
            F.count("*").alias("alike"), F.min("doc").alias("first_doc"), F.min_by("at", "doc").alias("first_at")
        ),
        "repeats-reached",
    )
    # Grams with an anchor that stands alone; one anchor of every other reach is what it is compared with.
    edged = reached.groupBy("gram").agg(F.min("alike").alias("least")).where("least = 1")
    first = (F.col("doc") == F.col("first_doc")) & (F.col("at") == F.col("first_at"))
    decided = (
        left.join(reached, ["gram", "reach"])
        .join(edged, "gram", "left")
        .groupBy("doc")
        .agg(
            F.collect_list(F.when(F.col("alike") > 1, F.col("at"))).alias("full"),
            F.collect_list(F.when(first & F.col("least").isNotNull(), F.col("at"))).alias("edge"),
        )
    )
    decided = stored(decided.join(lists.select("doc", "_key", "n_bytes"), "doc"), "repeats-decided")

    full = decided.select("_key", "n_bytes", F.explode("full").alias("at")).select(
        "_key",
        F.greatest(F.col("at") - (window - GRAM), F.lit(0)).cast("long").alias("start"),
        F.least(F.col("at") + window, F.col("n_bytes")).cast("long").alias("end"),
    )
    edges = decided.where(F.size("edge") > 0).select("_key", "doc", "edge")
    contexts = stored(
        texts.dropDuplicates(["_key"])
        .join(edges, "_key")
        .select("doc", "_text", "edge")
        .mapInArrow(_edge_contexts(window), "gram long, doc long, at int, left int, context binary"),
        "repeats-edges",
    )
    sizes = contexts.groupBy("gram").count()
    small = contexts.join(sizes.where((F.col("count") > 1) & (F.col("count") <= group_rows)), "gram").drop("count")
    large = contexts.join(sizes.where(F.col("count") > group_rows), "gram").drop("count")
    inside = (
        small.repartition("gram")
        .sortWithinPartitions("gram")
        .mapInPandas(_grouped(window), "doc long, start long, end long")
    )
    by_window = large.mapInPandas(_window_rows(window), "gram long, hash long, doc long, start long")
    twice = by_window.groupBy("gram", "hash").count().where("count > 1").drop("count")
    outside = by_window.join(twice, ["gram", "hash"]).select(
        "doc", "start", (F.col("start") + window).alias("end")
    )
    edged = inside.unionByName(outside).join(edges.select("doc", "_key"), "doc").select("_key", "start", "end")
    return full.unionByName(edged).withColumnRenamed("_key", "text_md5")


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _whole_characters(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a byte range that holds whole UTF-8 characters."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def _cut(carried: list[str], whole_characters: bool):
    """Apply merged ranges: the remaining bytes, the removed spans and their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, removed, sizes = [], [], [], []
            for text, starts, ends in zip(
                batch.column("_text"), batch.column("starts"), batch.column("ends"), strict=True
            ):
                data = text.as_py() or b""
                merged = []
                if starts.is_valid:
                    merged = _merged(
                        starts.values.to_numpy(zero_copy_only=False), ends.values.to_numpy(zero_copy_only=False)
                    )
                if whole_characters:
                    merged = [(s, e) for s, e in (_whole_characters(data, *x) for x in merged) if s < e]
                pieces, here = [], 0
                for s, e in merged:
                    pieces.append(data[here:s])
                    here = e
                pieces.append(data[here:])
                kept.append(b"".join(pieces))
                spans.append([{"start": s, "end": e} for s, e in merged])
                removed.append(sum(e - s for s, e in merged))
                sizes.append(len(data))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in carried],
                    pa.array(sizes, type=pa.int64()),
                    pa.array(removed, type=pa.int64()),
                    pa.array(spans, type=span),
                    pa.array(kept, type=pa.binary()),
                ],
                names=[*carried, "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def without_repeats(
    docs: DataFrame, text_col: str = "text", window: int = 200, carry: list[str] | None = None,
    whole_characters: bool = False,
) -> DataFrame:
    """The columns ``carry`` (default: all but the text) with what is left of each text.

    Adds ``n_bytes``, ``n_removed``, ``spans`` (maximal removed byte ranges,
    ascending) and ``kept`` (the remaining bytes, joined).  With
    ``whole_characters`` a span gives up the bytes of a character that it holds
    in part, so what remains of valid UTF-8 is valid.  Carried columns of
    these names are dropped.  Null text counts as empty; empty and short texts
    lose nothing of their own.  Repeated rows are copies of each other, so they
    lose everything from a window's length on.
    """
    own = {"n_bytes", "n_removed", "spans", "kept", text_col}
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in own]
    ranges = repeated_ranges(docs, text_col, window).distinct()
    ranges = ranges.groupBy("text_md5").agg(F.collect_list(F.struct("start", "end")).alias("r")).select(
        "text_md5", F.col("r.start").alias("starts"), F.col("r.end").alias("ends")
    )
    text = F.col(text_col).cast("binary")
    joined = (
        docs.select(*carry, text.alias("_text"), F.unhex(F.md5(text)).alias("_key"))
        .join(ranges, F.col("_key") == F.col("text_md5"), "left")
        .select(*carry, "_text", "starts", "ends")
    )
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return joined.mapInArrow(
        _cut(carry, whole_characters),
        fields + (", " if fields else "")
        + "n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary",
    )
