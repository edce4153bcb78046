"""Repair of conversation structure: cheapest edits into ``(system)? (user assistant)+``, with an audit.

Rows are put in order by one range exchange over conversation, turn, role and
text, so that a conversation of any size is dealt to as many tasks as it needs.
A task streams over its rows in *parts* of bounded size.  Conversations that lie
whole in one part are repaired there and then.  Of the others (the first and
last conversation of a task, and those longer than a part) the parts are written
out and finished in four steps, each of which handles one part, or one small row
per part, at a time:

1. texts seen in earlier parts are found, so that every row's fault is known;
2. the min-plus matrices of the parts (:mod:`toplist.llm.run_length`) are
   combined from the end: costs to go after every part;
3. every part tells where it leads from each of the four states, and the chain
   of states gives the one it starts in;
4. the parts are unrolled into edits and repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from toplist.llm import run_length as dp
from toplist.llm.common import GAP_CHARS, stored

# Rows and characters of a part, about.
PART_ROWS = 10_000
PART_CHARS = 8_000_000
# Leading characters of a text that take part in the range exchange (whole texts order the rows inside a range).
RANGE_CHARS = 64
# Endings of a whole text.
ENDINGS = ".!?"

COUNTS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "turns"]
_ROWS = "array<struct<role:string,text:string>>"
_PART = (
    "conv {conv}, block int, seq int, whole boolean, n_rows long, blank long, duplicate long, truncated long, "
    "illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string, symbols string, "
    "cost long, audit string, rows " + _ROWS
)


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``conv, turn, role, text, present``: rows damaged by the checksum of ``conv:turn``, modulo 20.

    0 drops the row (``present`` is false), 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 sets the role user.  A null is read as one space,
    except for the conversation and turn themselves, which stay null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")), F.lit(20))
    named = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space("role").alias("role"),
        space("text").alias("text"), kind.alias("kind"),
    )
    text = (
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text"))
    )
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return named.withColumn("copy", F.explode(copies)).select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") != 0).alias("present"),
    )


class _Part:
    """Rows of one conversation that follow each other, and what is known of them."""

    def __init__(self, conv: object, seq: int):
        self.conv, self.seq = conv, seq
        self.rows: list[tuple[str, str]] = []
        self.symbols: list[str] = []
        self.seen: set[tuple[str, str]] = set()
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = None
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        counts, row = self.counts, (role, text)
        bare = text.rstrip(GAP_CHARS)
        blank = not bare
        duplicate = not blank and row in self.seen
        truncated = not (blank or duplicate) and bare[-1] not in ENDINGS
        if not blank:
            self.seen.add(row)
        if self.rows:
            counts["illegal"] += self.rows[-1][0][:1] + role[:1] not in ("su", "ua", "au")
        if turn is not None:
            counts["turns"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        for name, found in (("n_rows", 1), ("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            counts[name] += found
        self.symbols.append(dp.symbol(role[:1], blank or duplicate, truncated))
        self.rows.append(row)
        self.chars += len(role) + len(text)

    def record(self, block: int, whole: bool) -> dict:
        """The part as a row; repaired where it is the whole conversation."""
        symbols, out = "".join(self.symbols), self.rows
        letters, cost = [], 0
        if whole:
            letters, cost, state = dp.unroll(symbols, 0, dp.END)
            last, more = dp.closing(state)
            out, cost = dp.apply(letters, self.rows, 0, last), cost + more
            letters.append(last)
        ends = [x[:1] for x in (self.rows[0][0], self.rows[-1][0])] if self.rows else [None, None]
        return {
            "conv": self.conv, "block": block, "seq": self.seq, "whole": whole, **self.counts,
            "first_turn": self.first_turn, "last_turn": self.last_turn, "first_role": ends[0], "last_role": ends[1],
            "symbols": None if whole else symbols, "cost": cost, "audit": "".join(letters),
            "rows": [{"role": r, "text": t} for r, t in out],
        }


def _cut(conv_type: pa.DataType, part_rows: int, part_chars: int):
    """``mapInArrow`` function over ordered rows of one block: its parts, whole conversations repaired."""
    schema = _arrow(conv_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []
        part: _Part | None = None
        # The first conversation of a block may have begun in the block before.
        split, block, seq, chars = True, 0, 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "present", "block")]
            for conv, turn, role, text, present, block in zip(*columns, strict=True):  # noqa: B020
                other = part is not None and part.conv != conv
                if other or (part is not None and (len(part.rows) >= part_rows or part.chars >= part_chars)):
                    ready.append(part.record(block, other and not split))
                    chars += part.chars
                    part, split = None, not other
                if part is None:
                    part, seq = _Part(conv, seq), seq + 1
                if present:
                    part.add(turn, role, text)
                if len(ready) >= 2_000 or chars >= part_chars:
                    yield pa.RecordBatch.from_pylist(ready, schema=schema)
                    ready, chars = [], 0
        if part is not None:
            # The last one may go on in the next block.
            ready.append(part.record(block, False))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)

    return run


def _arrow(conv_type: pa.DataType) -> pa.Schema:
    rows = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kinds = {"conv": conv_type, "block": pa.int32(), "seq": pa.int32(), "whole": pa.bool_(), "rows": rows}
    names = [x.split()[0] for x in _PART.split(", ")]
    text = {"first_role", "last_role", "symbols", "audit"}
    return pa.schema([(n, kinds.get(n, pa.string() if n in text else pa.int64())) for n in names])


def _mapped(df: DataFrame, run: Callable[[dict], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    """``run`` on every row of ``df`` (parts: few and bounded), one at a time."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([run(batch.slice(i, 1).to_pylist()[0])], schema=arrow)

    return df.mapInArrow(batches, schema)


def _with_later_duplicates(part: dict) -> dict:
    """Symbols of a part, rows at the places ``again`` marked as duplicates too."""
    again = set(part["again"] or ())
    symbols, counts = list(part["symbols"]), {x: part[x] for x in ("duplicate", "truncated")}
    for i in again:
        counts["duplicate"] += 1
        counts["truncated"] -= symbols[i].isupper() or symbols[i] == dp.OTHER_TRUNCATED
        symbols[i] = dp.GONE
    symbols = "".join(symbols)
    matrix = [x for row in dp.matrix(symbols) for x in row]
    return {"block": part["block"], "seq": part["seq"], "symbols": symbols, "matrix": matrix, **counts}


def _costs_to_go(table: pa.Table) -> pa.Table:
    """Costs to go after every part of one conversation."""
    table = table.sort_by([("block", "ascending"), ("seq", "ascending")])
    after, out = dp.END, []
    for flat in reversed(table["matrix"].to_pylist()):
        out.append(list(after))
        least = min(after := dp.advance(tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4)), after))
        after = tuple(c - least for c in after)
    to_go = pa.array(out[::-1], type=pa.list_(pa.int64()))
    return pa.table({"block": table["block"], "seq": table["seq"], "to_go": to_go})


def _leads_to(part: dict) -> dict:
    """The states that a part leads to from each state."""
    ends = [dp.unroll(part["symbols"], s, tuple(part["to_go"]))[2] for s in range(dp.STATES)]
    return {"block": part["block"], "seq": part["seq"], "ends": ends}


def _starts(table: pa.Table) -> pa.Table:
    """The state that every part of one conversation starts in, and whether it is the last."""
    table = table.sort_by([("block", "ascending"), ("seq", "ascending")])
    state, starts = 0, []
    for ends in table["ends"].to_pylist():
        starts.append(state)
        state = ends[state]
    last = [i == len(starts) - 1 for i in range(len(starts))]
    return pa.table({"block": table["block"], "seq": table["seq"], "start": pa.array(starts, pa.int32()), "last": last})


def _repaired(part: dict) -> dict:
    letters, cost, state = dp.unroll(part["symbols"], part["start"], tuple(part["to_go"]))
    last, more = dp.closing(state) if part["last"] else ("", 0)
    rows = [(r["role"], r["text"]) for r in part["rows"]]
    out = [{"role": r, "text": t} for r, t in dp.apply(letters, rows, part["start"], last)]
    kept = {x: part[x] for x in part if x not in ("start", "last", "to_go")}
    return kept | {"audit": "".join(letters) + last, "cost": cost + more, "symbols": None, "rows": out}


def repair(
    rows: DataFrame, present: Column | None = None, conv_col: str = "conv", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", part_rows: int = PART_ROWS, part_chars: int = PART_CHARS,
) -> DataFrame:
    """The repaired conversations, in parts of about ``part_rows`` rows or ``part_chars`` characters.

    A conversation's rows are taken by turn (nulls first), rows of one turn by
    role and text.  Each row's first fault counts: blank (no character other
    than white space), duplicate (role and text seen earlier), truncated (last
    such character not ``.!?``).  Edits: Keep, Rerole to user or assistant,
    Delete (required for blank and duplicate), Insert an empty user or
    assistant row; undeleted truncated rows cost more (:mod:`run_length` has the
    costs).  ``audit`` has the initials of the cheapest edits whose result has
    the role initials ``(s?(ua)+)?``, the least in ASCII order of equally cheap
    ones; ``rows`` is the result.  Initials are the first characters of roles.

    Nulls in role and text are read as one space; a null conversation is one
    conversation.  Rows for which ``present`` is not true only make their
    conversation appear.  ``whole`` parts are whole conversations; the others
    follow each other by ``block`` and ``seq``.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    given = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"),
        space(text_col).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    order = ["conv", "turn", "role"]
    ordered = given.repartitionByRange(*order, F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(*order, "text")
    conv = given.schema["conv"].dataType
    arrow, schema = _arrow(to_arrow_type(conv)), _PART.format(conv=conv.simpleString())
    parts = stored(
        ordered.withColumn("block", F.spark_partition_id()).mapInArrow(_cut(to_arrow_type(conv), part_rows, part_chars), schema),
        "repair-parts",
    )
    split = parts.where("not whole")

    # Rows whose role and text an earlier part has: a part lists each of its texts once.
    texts = split.select("conv", "block", "seq", "symbols", F.posexplode("rows").alias("at", "row")).where(
        F.substring("symbols", F.col("at") + 1, F.lit(1)) != dp.GONE
    )
    place = F.struct("block", "seq")
    first = F.min(place).over(Window.partitionBy("conv", "row"))
    again = texts.withColumn("again", first < place).where("again").groupBy("block", "seq").agg(F.collect_list("at").alias("again"))
    key = ["block", "seq"]
    long_list = pa.list_(pa.int64())
    head = [("block", pa.int32()), ("seq", pa.int32())]
    known = stored(
        _mapped(
            split.select(*key, "symbols", "duplicate", "truncated").join(again, key, "left"), _with_later_duplicates,
            "block int, seq int, symbols string, matrix array<long>, duplicate long, truncated long",
            pa.schema([*head, ("symbols", pa.string()), ("matrix", long_list), ("duplicate", pa.int64()), ("truncated", pa.int64())]),
        ).join(split.select(*key, "conv"), key),
        "repair-known",
    )
    to_go = known.select("conv", *key, "matrix").groupBy("conv").applyInArrow(
        _costs_to_go, "block int, seq int, to_go array<long>"
    )
    known = stored(known.drop("matrix").join(to_go, key), "repair-to-go")
    ends = _mapped(
        known.select(*key, "symbols", "to_go"), _leads_to, "block int, seq int, ends array<int>",
        pa.schema([*head, ("ends", pa.list_(pa.int32()))]),
    )
    starts = known.select("conv", *key).join(ends, key).groupBy("conv").applyInArrow(
        _starts, "block int, seq int, start int, last boolean"
    )
    asked = split.drop("symbols", "duplicate", "truncated").join(known.drop("conv"), key).join(starts, key)
    names = [f.name for f in arrow]
    finished = _mapped(
        asked.select(*names, "to_go", "start", "last"), _repaired, schema, arrow
    )
    return parts.where("whole").unionByName(finished).drop("symbols")


def _joined(table: pa.Table) -> pa.Table:
    """One row for the parts of a conversation: sums, with what lies between neighbours."""
    table = table.sort_by([("block", "ascending"), ("seq", "ascending")])
    parts = table.to_pylist()
    total = {x: sum(p[x] for p in parts) for x in [*COUNTS, "cost"]}
    filled = [p for p in parts if p["n_rows"]]
    for p, q in zip(filled, filled[1:], strict=False):
        total["illegal"] += (p["last_role"] or "") + (q["first_role"] or "") not in ("su", "ua", "au")
    dated = [p for p in parts if p["first_turn"] is not None]
    for p, q in zip(dated, dated[1:], strict=False):
        total["turns"] -= p["last_turn"] == q["first_turn"]
    out = {
        "conv": parts[0]["conv"], **total, "audit": "".join(p["audit"] for p in parts),
        "first_turn": dated[0]["first_turn"] if dated else None, "last_turn": dated[-1]["last_turn"] if dated else None,
    }
    schema = pa.schema(
        [("conv", table.schema.field("conv").type)]
        + [(x, pa.int64()) for x in [*COUNTS, "cost", "first_turn", "last_turn"]] + [("audit", pa.string())]
    )
    return pa.Table.from_pylist([out], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the texts of each conversation, its parts one after the other: one batch of parts in memory."""
    now, digest, out, schema = None, None, [], None

    def close() -> None:
        if digest is not None:
            out.append({"conv": now, "repaired_sha256": digest.hexdigest()})

    some = False
    for batch in batches:
        schema = pa.schema([("conv", batch.schema.field("conv").type), ("repaired_sha256", pa.string())])
        for i in range(batch.num_rows):
            conv, rows = batch["conv"][i].as_py(), batch["rows"][i].as_py()
            if digest is None or conv != now:
                close()
                now, digest, some = conv, hashlib.sha256(), False
            for row in rows:
                digest.update((("\n" if some else "") + row["role"] + ":" + row["text"]).encode())
                some = True
    close()
    if schema is not None:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def summary(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation of :func:`repair`: ``gaps``, faults, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.

    ``gaps`` is the number of turns missing between the first and the last one
    (nulls ignored), ``illegal`` the number of neighbouring rows whose role
    initials are not ``su``, ``ua`` or ``au``, before the repair.
    ``repaired_sha256`` is of the repaired rows as ``role:text`` lines.
    A conversation without rows has zeros, an empty audit and the hash of nothing.
    """
    measures = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    lines = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    whole = parts.where("whole").select(
        F.col("conv").alias(conv_col), gaps, *measures, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256")
    )
    conv = parts.schema["conv"].dataType.simpleString()
    split = parts.where("not whole")
    counts = ", ".join(x + " long" for x in [*COUNTS, "cost", "first_turn", "last_turn"])
    joined = split.drop("rows").groupBy("conv").applyInArrow(_joined, f"conv {conv}, {counts}, audit string")
    digests = (
        split.select("conv", "block", "seq", "rows").repartition("conv").sortWithinPartitions("conv", "block", "seq")
        .mapInArrow(_digests, f"conv {conv}, repaired_sha256 string")
    )
    both = joined.join(digests.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")))
    return whole.unionByName(both.select(F.col("conv").alias(conv_col), gaps, *measures, "repaired_sha256"))
