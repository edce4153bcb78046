"""Best-fit packing of token pieces into sequences by hierarchical residual rounds.

Round 0 deals the pieces to groups and packs each group by best fit (longest
first, into the fullest bin that still has room).  Bins that no remaining bin
could still join are emitted.  The others, each as one item with its pieces in
place, go up a tree: groups are merged, their underfull bins are best-fit
packed again, and so on until one group is left or a round joins nothing.

A group holds a bounded number of items in every round: the tree only merges
as many groups as their underfull bins allow.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplist.llm.common import packed, stored
from toplist.llm.tokens import id_mapper, id_type, with_row

# Items packed together in one task (about).
ITEMS_PER_GROUP = 50_000
# Groups merged into one from a round to the next, at most.
FAN_IN = 8


def _cut(capacity: int, kind: str | None):
    """Pieces of every id list: ``piece, start, length, ids_crc32`` and, with a ``kind``, the ids (little-endian)."""

    def shape(texts: list[np.ndarray]):
        rows, piece, start, length, digest, ids = [], [], [], [], [], []
        for row, x in enumerate(texts):
            first = len(x) % capacity or capacity
            edges = [0, *range(first, len(x) + 1, capacity)]
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                rows.append(row)
                piece.append(i)
                start.append(a)
                length.append(b - a)
                digest.append(zlib.crc32(x[a:b].astype("<u4").tobytes()))
                if kind:
                    ids.append(x[a:b].astype(kind).tobytes())
        columns = [
            pa.array(piece, type=pa.int32()),
            pa.array(start, type=pa.int64()),
            pa.array(length, type=pa.int64()),
            pa.array(digest, type=pa.int64()),
        ]
        names = ["piece", "start", "length", "ids_crc32"]
        if kind:
            columns, names = [*columns, pa.array(ids, type=pa.binary())], [*names, "ids"]
        return np.array(rows, dtype=np.int64), columns, names

    return shape


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, text_col: str = "text", carry: list[str] | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """``_row`` (struct of the carried columns) and the pieces of every document.

    Null and empty texts have ``end_id`` alone.  Only documents of more than
    ``capacity`` ids are cut, into full pieces; the first may be shorter.
    ``ids`` are little-endian, of 16 bits where the vocabulary fits and 32
    otherwise, and left out unless ``with_ids``; ``ids_crc32`` is of the 32-bit
    form in either case.
    """
    carry = carry if carry is not None else [c for c in docs.columns if c != text_col]
    frame, row = with_row(docs, carry, text_col)
    return frame.mapInArrow(
        id_mapper(tokenizer, end_id, _cut(capacity, id_type(tokenizer, end_id) if with_ids else None)),
        f"{row}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""),
    )


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of every item, items placed in the given order into the fullest bin with room.

    Open bins are stacked by the room they have left; a bit set tells which
    stacks hold any, so an item finds its bin without a search.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins, out = 0, 0, []
    for size in sizes:
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            place = stacks[room].pop()
            if not stacks[room]:
                some &= ~(1 << room)
        else:
            room, place, bins = capacity, bins, bins + 1
        out.append(place)
        stacks[room - size].append(place)
        some |= 1 << (room - size)
    return out


def _pack_group(capacity: int, round_number: int):
    """``applyInArrow`` function: joins the group's bins by best fit and moves their pieces."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bins, place = np.unique(rows["bin"].to_numpy(), return_inverse=True)
        fill = np.zeros(len(bins), dtype=np.int64)
        np.add.at(fill, place, rows["length"].to_numpy())
        order = np.lexsort((bins, -fill))
        into = np.empty(len(bins), dtype=np.int64)
        into[order] = best_fit(fill[order].tolist(), capacity)
        # Inside a bin, items follow each other in the order they were placed.
        rank = np.empty(len(bins), dtype=np.int64)
        rank[order] = np.arange(len(bins))
        laid = np.lexsort((rank, into))
        ends = np.cumsum(fill[laid])
        base = ends - fill[laid]
        heads = np.r_[True, into[laid][1:] != into[laid][:-1]]
        shift = np.empty(len(bins), dtype=np.int64)
        shift[laid] = base - np.maximum.accumulate(np.where(heads, base, 0))
        filled = np.bincount(into, weights=fill).astype(np.int64)
        moved = {
            "offset": rows["offset"].to_numpy() + shift[place],
            "fill": filled[into[place]],
            # Unique over rounds and groups.
            "bin": (np.int64(round_number) << 56) + (np.int64(key[0].as_py()) << 28) + into[place],
        }
        for name, values in moved.items():
            at = rows.schema.get_field_index(name)
            rows = rows.set_column(at, rows.schema.field(at), pa.array(values, type=pa.int64()))
        return rows

    return run


def pack(pieces: DataFrame, capacity: int, items_per_group: int = ITEMS_PER_GROUP) -> DataFrame:
    """``pieces`` (with a long ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Every row is placed; rows of a sequence follow each other without gaps from
    offset 0.  Input columns named like the outputs are replaced.  Which
    sequence a row gets is fixed once the result is stored.
    """
    pieces = pieces.drop("sequence_id", "offset")
    # The input travels as one struct: its names cannot clash with those of the rounds.
    items = stored(
        pieces.select(packed(pieces, pieces.columns, "piece"), "length", F.monotonically_increasing_id().alias("bin")),
        "pack-items",
    )
    groups = max(1, -(-items.count() // items_per_group))
    todo = items.withColumns(
        {
            "offset": F.lit(0).cast("long"),
            "fill": F.col("length"),
            "group": F.pmod(F.xxhash64("bin"), F.lit(groups)).cast("int"),
        }
    )
    # Full pieces are sequences already.
    done = [todo.where(F.col("length") >= capacity)]
    todo = todo.where(F.col("length") < capacity)
    before, level = None, 1
    while True:
        laid = stored(
            todo.groupBy("group").applyInArrow(_pack_group(capacity, level), todo.schema), "pack-round"
        )
        bins = laid.groupBy("bin").agg(F.first("fill").alias("fill"))
        least = bins.agg(F.min("fill"), F.count("*")).first()
        if least[1] == 0 or groups == 1 or least[1] == before:
            done.append(laid)
            break
        # A bin that has less room than the emptiest bin fills can take no other.
        open_bins = F.col("fill") <= capacity - least[0]
        done.append(laid.where(~open_bins))
        residue = laid.where(open_bins)
        left = bins.where(open_bins).count()
        if left == 0:
            break
        before = left
        fan = max(2, min(FAN_IN, (items_per_group * groups) // left))
        if items_per_group * groups < 2 * left:
            # Merging would outgrow a task: the bins that remain hardly join.
            done.append(residue)
            break
        groups = -(-groups // fan)
        todo = residue.withColumn("group", F.floor(F.col("group") / fan).cast("int"))
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("piece.*", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Pieces of all documents with their ids, ``sequence_id`` and ``offset``; carried columns in ``_row``.

    Only the pieces' lengths go through the packing rounds; the ids are stored
    once and meet their places in one join.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, text_col, carry)
    pieces = stored(pieces.withColumn("piece_id", F.monotonically_increasing_id()), "pack-pieces")
    places = pack(pieces.select("piece_id", "length"), capacity).drop("length")
    return pieces.join(places, "piece_id").drop("piece_id")
