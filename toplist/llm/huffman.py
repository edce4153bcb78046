"""Token ids as binary shards, by canonical length-limited Huffman coding.

Code lengths come from the counts of every id in the corpus (package-merge,
at most ``MAX_BITS`` bits) and codes are canonical, so the table of lengths is
the whole code book.  A shard holds a range of documents in ascending order:
its ids are coded back to back, most significant bit first, and the bit offset
of every ``block`` ids is kept, so blocks decode independently; a decoder
reads ``MAX_BITS`` bits at a time and finds the id and its length in one table.

Shards are rows of a Parquet table written and read by Spark, so they lie in
any store that Spark reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplist.llm.common import running_totals, stored
from toplist.llm.tokens import id_mapper, id_type, with_row
from toplist.session import scratch_dir

# The longest code and the ids between two checkpoints.
MAX_BITS = 16
BLOCK = 256
# Ids of a shard (about; a shard ends with a document).
SHARD_IDS = 1_000_000


def code_lengths(ids: np.ndarray, counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code length of every id under the limit (package-merge).

    ``counts`` are positive; one id alone gets one bit.  Raises when there are
    more ids than codes of ``max_bits`` bits.
    """
    n = len(ids)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit codes of {max_bits} bits")
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    order = np.lexsort((ids, counts))
    weight = counts[order].astype(np.int64)
    # Level by level, pairs of the previous row are merged with the leaves; only the
    # number of leaves among the items chosen matters for the lengths.
    rows = [(weight, np.ones(n, dtype=bool))]
    for _ in range(max_bits - 1):
        last = rows[-1][0]
        pairs = last[: len(last) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, pairs])
        leaf = np.concatenate([np.ones(n, dtype=bool), np.zeros(len(pairs), dtype=bool)])
        by = np.argsort(merged, kind="stable")
        rows.append((merged[by], leaf[by]))
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for _, leaf in reversed(rows):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes of a table of lengths (0: the id does not occur)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = int(self.lengths.max(initial=1))
        used = np.nonzero(self.lengths)[0]
        order = used[np.lexsort((used, self.lengths[used]))]
        # In canonical order every code starts where the one before ends, read as a binary fraction.
        width = np.int64(1) << (self.bits - self.lengths[order])
        start = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = (start >> (self.bits - self.lengths[order])).astype(np.uint64)
        self.id_at = np.zeros(1 << self.bits, dtype=np.int32)
        table = np.repeat(order, width)
        self.id_at[: len(table)] = table

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The coded bits (with padding for the decoder) and the bit offset of every block."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        starts = ends - size
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 3, dtype=np.uint64)
        if len(ids):
            code, word = self.codes[ids], starts >> 6
            # Codes of one word do not overlap, so their sum is their union.
            free = np.int64(64) - (starts & 63) - size
            high = np.where(
                free >= 0,
                code << np.maximum(free, 0).astype(np.uint64),
                code >> np.maximum(-free, 0).astype(np.uint64),
            )
            first = np.r_[0, np.nonzero(np.diff(word))[0] + 1]
            words[word[first]] = np.add.reduceat(high, first)
            over = np.nonzero(free < 0)[0]
            words[word[over] + 1] += code[over] << (64 + free[over]).astype(np.uint64)
        return words.astype(">u8").tobytes(), starts[::block].copy()

    def decode(self, data: bytes, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """The ``n`` ids of a shard: all blocks step by step side by side, each from its checkpoint."""
        octets = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        # The 24 bits at every byte hold any code, whichever of its 8 bits it starts at.
        three = (octets[:-2] << 16) | (octets[1:-1] << 8) | octets[2:]
        out = np.zeros(len(offsets) * block, dtype=np.int32)
        at = offsets.astype(np.int64).copy()
        shift, mask = 24 - self.bits, (1 << self.bits) - 1
        lanes = np.arange(len(offsets)) * block
        for step in range(min(block, n)):
            if len(lanes) and lanes[-1] + step >= n:
                lanes, at = lanes[:-1], at[:-1]
            peek = (three[at >> 3] >> (shift - (at & 7))) & mask
            found = self.id_at[peek]
            out[lanes + step] = found
            at += self.lengths[found]
        return out[:n]


def _id_lists(kind: str):
    def shape(texts: list[np.ndarray]):
        ids = pa.array([x.astype(kind).tobytes() for x in texts], type=pa.binary())
        sizes = pa.array([len(x) for x in texts], type=pa.int64())
        return np.arange(len(texts)), [ids, sizes], ["ids", "n_tokens"]

    return shape


def _counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind)
            part = np.bincount(ids, minlength=len(total)).astype(np.int64)
            part[: len(total)] += total
            total = part
        seen = np.nonzero(total)[0]
        columns = [pa.array(seen, type=pa.int32()), pa.array(total[seen], type=pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "uses"])

    return run


def _encoder(lengths: np.ndarray, kind: str, shard_ids: int):
    """Sorted documents of a partition to shards of about ``shard_ids`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, many, seq = Codes(lengths), [], 0, 0

        def shard() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), dtype=kind).astype(np.int64)
            data, offsets = codes.encode(ids)
            own = rows["_row"].combine_chunks()
            whole = pa.array([0, len(own)], type=pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    rows["part"].combine_chunks().slice(0, 1),
                    pa.array([seq], type=pa.int64()),
                    pa.array([len(ids)], type=pa.int64()),
                    pa.ListArray.from_arrays(whole, own),
                    pa.ListArray.from_arrays(whole, rows["n_tokens"].combine_chunks()),
                    pa.array([offsets.tolist()], type=pa.list_(pa.int64())),
                    pa.array([data], type=pa.binary()),
                ],
                names=["part", "seq", "n_ids", "rows", "sizes", "checkpoints", "data"],
            )

        for batch in batches:
            first = 0
            for i, n in enumerate(batch.column("n_tokens").to_pylist()):
                many += n
                if many >= shard_ids:
                    held.append(batch.slice(first, i + 1 - first))
                    yield shard()
                    held, many, seq, first = [], 0, seq + 1, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield shard()

    return run


def _decoder(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                sizes = np.array(row["sizes"].as_py(), dtype=np.int64)
                offsets = np.array(row["checkpoints"].as_py(), dtype=np.int64)
                ids = codes.decode(row["data"].as_py(), offsets, row["n_ids"].as_py()).astype("<u4")
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        row["rows"].values,
                        pa.array(row["start"].as_py() + ends - sizes),
                        pa.array(sizes),
                        pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], type=pa.binary()),
                    ],
                    names=["_row", "start", "n_tokens", "ids"],
                )

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode all texts, ``end_id`` after each, and write shards, their index and the code book under ``path``.

    Documents are laid out in ascending ``id_col`` (null first; equal ids in the
    order of their token bytes).  Null text counts as empty: ``end_id`` alone.
    An empty table leaves an empty code book and no shard.
    """
    kind = id_type(tokenizer, end_id)
    frame, row = with_row(docs, [id_col], text_col)
    tokens = stored(
        frame.mapInArrow(id_mapper(tokenizer, end_id, _id_lists(kind)), f"{row}, ids binary, n_tokens long"),
        "huffman-ids",
    )
    # One row per id of the vocabulary at most.
    counted = tokens.select("ids").mapInArrow(_counts(kind), "id int, uses long").groupBy("id")
    rows = counted.agg(F.sum("uses").alias("uses")).orderBy("id").collect()
    ids = np.array([r["id"] for r in rows], dtype=np.int64)
    lengths = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int64)
    if len(ids):
        lengths[ids] = code_lengths(ids, np.array([r["uses"] for r in rows], dtype=np.int64))
    spark = docs.sparkSession
    book = [(int(i), int(lengths[i])) for i in ids]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(path + "/codes")

    key = f"_row.{id_col}"
    (
        tokens.repartitionByRange(key)
        .sortWithinPartitions(key, "ids")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(
            _encoder(lengths, kind, shard_ids),
            f"part int, seq long, n_ids long, rows array<{row.removeprefix('_row ')}>, sizes array<long>, "
            "checkpoints array<long>, data binary",
        )
        .write.parquet(path + "/shards")
    )
    shards = spark.read.parquet(path + "/shards").select("part", "seq", "n_ids")
    starts = running_totals(shards, ["part", "seq"], ["n_ids"], "huffman-starts")
    starts.select("part", "seq", F.col("before_n_ids").alias("start")).write.parquet(path + "/index")


def read_tokens(spark, path: str) -> DataFrame:
    """``_row`` (struct of the id), ``start``, ``n_tokens`` and ``ids`` of every document, decoded from ``path``."""
    book = spark.read.parquet(path + "/codes").collect()  # one row per id of the vocabulary at most
    lengths = np.zeros(max([r["id"] for r in book], default=0) + 1, dtype=np.int64)
    for r in book:
        lengths[r["id"]] = r["bits"]
    # The index has one short row per shard; the planner broadcasts it while it is small.
    shards = spark.read.parquet(path + "/shards").join(spark.read.parquet(path + "/index"), ["part", "seq"])
    kind = shards.schema["rows"].dataType.elementType.simpleString()
    return shards.mapInArrow(_decoder(lengths), f"_row {kind}, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' tokens to a fresh folder of the shared scratch space and read them back."""
    path = scratch_dir(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path)
