"""Token ids of whole texts by the tokenizers library, remembered per chunk.

A tokenizer that splits its input at white space before merging gives a text
the concatenation of its chunks' ids, where a chunk is a run of white space and
the run of other characters after it; such a tokenizer also ends a piece where
a run of letters ends, so a chunk of letters and what follows them is two parts
(letters of a few alphabets only: others may be normalized to a letter and a mark
of its own, which joins those after it).  Corpora repeat their chunks, so each worker asks the
library for a chunk once and looks it up afterwards.  Most texts have single
spaces between their words and perhaps line breaks inside a run of others: these
are cut at the spaces and the distinct pieces of many texts found by Arrow, so
that only distinct ones are looked up; new ones are asked for many at a time.
Texts with white space other than the ASCII one, where a run could reach
over a cut, are encoded whole.

A tokenizer that lower-cases its input and drops white space needs fewer distinct
pieces: texts of letters that have one lower-case form are lower-cased and cut at
all white space and where a mark follows a letter, and their pieces asked of the
library without its normalizer, which would leave them as they are.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, compress, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunks remembered per worker; beyond it those met once are forgotten, or all where that leaves too many (speed and memory only).
REMEMBERED_CHUNKS = 1_000_000
# ASCII white space, and white space or separators outside it (Arrow's notation).
_CHUNK = re.compile("[ \\t\\n\\x0b\\x0c\\r]*[^ \\t\\n\\x0b\\x0c\\r]+|[ \\t\\n\\x0b\\x0c\\r]+")
_OTHER_SPACE = (
    r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
)
# Pieces asked of the library as one text.
PIECES_PER_TEXT = 200
# Fixed value: white space that makes a text one that is not cut at its spaces (a space beside a line break, or any other).
_UNEVEN = r"  | \n|\n |[\t\x0b\x0c\r]"
# Fixed value: ASCII marks that are neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Letters that lower-casing and NFC leave one letter each, and a run of them with what may follow it:
# marks, and lines of letters and marks (letters right after a mark could be a contraction or an added token).
_LETTERS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+"
_MARKS = r"[!-/:-@\[-`{-~]*"
_PLAIN = rf"\A(?P<stem>{_LETTERS})(?P<rest>{_MARKS}(?:\n{_LETTERS}{_MARKS})*)\z"
# The layout of tokenizers that lower-case and drop white space.
_FOLDING = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "behavior": "Removed", "invert": True,
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
# What such a tokenizer may change otherwise than by lower-casing one character (all but ASCII, the Latin
# letters that NFC leaves alone and common marks), and a run of lower-case letters.
_UNFOLDABLE = (
    r"[^\x00-\x1b\x20-\x{84}\x{86}-\x{9f}\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}]"
)
_FOLDED = r"\A[a-z\x{df}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+\z"
# Bytes that are white space (1), marks (2), lower-case letters (3).
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[list(b" \t\n\x0b\x0c\r")] = 1
_KINDS[list(MARKS.encode())] = 2
_KINDS[ord("a") : ord("z") + 1] = 3


class ChunkTokenizer:
    """Ids of texts by a tokenizer file, with the chunks seen so far kept as one flat table."""

    def __init__(self, path: str, remembered: int = REMEMBERED_CHUNKS):
        # The executor's cores are Spark's to share out.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.remembered = remembered
        # Strings that are one token wherever they stand, marks included.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Ids that only the first token of a spaced run of letters has.
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.heads = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.heads[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        # Ids that only the last one has.
        self.tails = np.zeros(len(self.heads), dtype=bool)
        self.tails[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        # Whether texts are lower-cased and cut at all white space here.
        self.folds = all(spec[k] == v for k, v in _FOLDING.items()) and not any(
            t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
            for t in spec["added_tokens"]
        )
        self.normalizer = self.library.normalizer
        self._forget()

    def _forget(self) -> None:
        # Chunks as they stand, pieces that follow a space, by what follows it, and lower-cased pieces.
        self.place: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.folded: dict[str, int] = {}
        self.ids, self.first, self.size, self.met = array("i"), array("q"), array("i"), array("i")

    def _forget_rare(self) -> None:
        """Keep what was met in two batches or more, unless that is more than half of what may be kept."""
        keep = np.flatnonzero(np.asarray(self.met) > 1)
        if 2 * len(keep) > self.remembered:
            self._forget()
            return
        ids, sizes = self._ids_at(keep)
        place = np.full(len(self.met), -1, dtype=np.int64)
        place[keep] = np.arange(len(keep))
        moved = [{c: p for c, p in zip(own, place[list(own.values())].tolist(), strict=True) if p >= 0} if own else {}
                 for own in (self.place, self.spaced, self.folded)]
        self._forget()
        self._add([], ids, sizes, {})
        self.place, self.spaced, self.folded = moved

    def _asked(self, texts: list[str], own: dict[str, int] | None, offsets: bool = False) -> list:
        """The library's encodings; lower-cased pieces without its normalizer, which takes it half its time."""
        encode = self.library.encode_batch if offsets else self.library.encode_batch_fast
        if own is not self.folded:
            return encode(texts, add_special_tokens=False)
        self.library.normalizer = None
        try:
            return encode(texts, add_special_tokens=False)
        finally:
            self.library.normalizer = self.normalizer

    def _whole(self, texts: list[str], own: dict[str, int] | None = None) -> list[list[int]]:
        return [e.ids for e in self._asked(texts, own)]

    def _add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray, into: dict[str, int]) -> None:
        into.update(zip(chunks, range(len(self.first), len(self.first) + len(chunks)), strict=True))
        self.first.frombytes((len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.size.frombytes(sizes.astype(np.int32).tobytes())
        self.met.frombytes(bytes(4 * len(sizes)))
        self.ids.frombytes(ids.astype(np.int32).tobytes())

    def _ask(self, chunks: list[str], into: dict[str, int], ahead: str = "") -> None:
        """Ids of ``ahead + chunk`` for every chunk, each a text of its own."""
        found = self._whole([ahead + c for c in chunks] if ahead else chunks, into)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
        self._add(chunks, ids, sizes, into)

    def _ask_spaced(self, pieces: list[str], into: dict[str, int]) -> None:
        """Ids of ``" " + piece`` for every piece: many pieces make one text, whose ids are shared out by their places in it."""
        for some in (pieces[i : i + 50 * PIECES_PER_TEXT] for i in range(0, len(pieces), 50 * PIECES_PER_TEXT)):
            groups = [some[i : i + PIECES_PER_TEXT] for i in range(0, len(some), PIECES_PER_TEXT)]
            found = self._asked([" " + " ".join(g) for g in groups], into, offsets=True)
            sizes = []
            for group, encoding in zip(groups, found, strict=True):
                at = np.fromiter((a for a, _ in encoding.offsets), dtype=np.int64, count=len(encoding))
                starts = np.cumsum([0, *(len(p) + 1 for p in group)])
                sizes.append(np.diff(np.searchsorted(at, starts)))
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), dtype=np.int32)
            self._add(some, ids, np.concatenate(sizes), into)

    def _ask_letters(self, words: list[str], into: dict[str, int]) -> None:
        """As ``_ask_spaced`` for runs of letters, whose first or last token tells where each ends."""
        for some in (words[i : i + 50 * PIECES_PER_TEXT] for i in range(0, len(words), 50 * PIECES_PER_TEXT)):
            groups = [" " + " ".join(some[i : i + PIECES_PER_TEXT]) for i in range(0, len(some), PIECES_PER_TEXT)]
            found = self._whole(groups, into)
            ids = np.fromiter(chain.from_iterable(found), dtype=np.int32)
            heads, ends = np.flatnonzero(self.heads[ids]), np.flatnonzero(self.tails[ids]) + 1
            if len(heads) == len(some) and heads[0] == 0:
                self._add(some, ids, np.diff(np.r_[heads, len(ids)]), into)
            elif len(ends) == len(some) and ends[-1] == len(ids):
                self._add(some, ids, np.diff(np.r_[0, ends]), into)
            else:
                self._ask_spaced(some, into)

    def _learn(self, new: list[str], own: dict[str, int]) -> None:
        """Remember new, distinct chunks.  One of letters and more is its two parts, known or asked for alone."""
        if own is self.folded:
            letters = pc.match_substring_regex(pa.array(new, type=pa.string()), _FOLDED).to_numpy(zero_copy_only=False)
            if letters.any():
                self._ask_letters(list(compress(new, letters)), own)
            if not letters.all():
                self._ask_spaced(list(compress(new, ~letters)), own)
            return
        parts = pc.extract_regex(pa.array(new, type=pa.string()), _PLAIN)
        plain = parts.is_valid()
        odd = [new[i] for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist()]
        parts = parts.drop_null()
        stems, rests = _strings(parts.field("stem")), _strings(parts.field("rest"))
        words = list(set(stems).difference(own))
        if own is self.spaced:
            if words:
                self._ask_letters(words, own)
            # Asked for alone: what would join the space of the next piece, and what an added token could reach out of.
            alone = [p for p in odd if not p or p.endswith("\n") or any(x in p for x in self.added)]
            if alone:
                self._ask(alone, own, " ")
            if more := [p for p in odd if p not in own]:
                self._ask_spaced(more, own)
        else:
            self._ask([*odd, *words], own)
        if any(rests):
            self._ask(list(set(rests).difference(self.place, [""])), self.place)
            stems, rests = list(compress(stems, rests)), list(filter(None, rests))
            at = np.empty((len(rests), 2), dtype=np.int64)
            at[:, 0] = np.fromiter(map(own.__getitem__, stems), dtype=np.int64, count=len(stems))
            at[:, 1] = np.fromiter(map(self.place.__getitem__, rests), dtype=np.int64, count=len(rests))
            ids, sizes = self._ids_at(at.ravel())
            self._add(list(map(str.__add__, stems, rests)), ids, sizes.reshape(-1, 2).sum(axis=1), own)

    def _places(self, chunks: list[str], own: dict[str, int]) -> np.ndarray:
        """Where the distinct chunks are remembered; new ones are learnt."""
        at = np.fromiter(map(own.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [chunks[i] for i in missing]
            self._learn(new, own)
            at[missing] = [own[c] for c in new]
        np.asarray(self.met)[at] += 1
        return at

    def _ids_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered chunks one after the other, and how many each has."""
        # Views: gone when this returns, so that the arrays can grow again.
        n = np.asarray(self.size)[at].astype(np.int64)
        return _runs(np.asarray(self.ids), np.asarray(self.first)[at], n), n

    def _expanded(self, chunks: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after the other, and how many each has."""
        found = chunks.dictionary_encode()
        codes, distinct = found.indices.to_numpy().astype(np.int64), found.dictionary
        at = np.full(2 * len(distinct), -1, dtype=np.int64)
        codes += np.where(spaced, 0, len(distinct))
        used = np.zeros(len(at), dtype=bool)
        used[codes] = True
        for own, start in ((self.spaced, 0), (self.place, len(distinct))):
            here = np.flatnonzero(used[start : start + len(distinct)])
            if len(here):
                at[start + here] = self._places(_strings(distinct.take(pa.array(here))), own)
        # Only what these texts use is gathered from, which is small.
        ids, n = self._ids_at(at[used])
        sizes, first = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        sizes[used], first[used] = n, np.cumsum(n) - n
        return _runs(ids, first[codes], sizes[codes]), sizes[codes]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text."""
        if len(self.place) + len(self.spaced) + len(self.folded) >= self.remembered:
            self._forget_rare()
        out: list[np.ndarray] = [None] * len(texts)
        column = pa.array(texts, type=pa.string())
        rows = np.arange(len(texts))
        if self.folds:
            rows = self._encode_folded(column, out)
            column = column.take(pa.array(rows))
        if len(rows):
            self._encode_rows(column, rows, out)
        return out

    def _encode_folded(self, column: pa.Array, out: list) -> np.ndarray:
        """Put the ids of texts that can be lower-cased here into ``out``; the rows of the others."""
        lower = pc.utf8_lower(column)
        other = pc.match_substring_regex(column, _UNFOLDABLE)
        for added in self.added:
            other = pc.or_(other, pc.match_substring(lower, added, ignore_case=True))
        other = other.to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~other)
        if len(rows):
            pieces, edges = _pieces(lower if len(rows) == len(lower) else lower.take(pa.array(rows)))
            found = pieces.dictionary_encode()
            ids, n = self._ids_at(self._places(_strings(found.dictionary), self.folded))
            codes = found.indices.to_numpy()
            sizes = n[codes]
            self._share(out, rows, _runs(ids, (np.cumsum(n) - n)[codes], sizes), sizes, edges)
        return np.flatnonzero(other)

    def _encode_rows(self, column: pa.Array, places: np.ndarray, out: list) -> None:
        """Put the ids of each text into ``out``, at the place given for it."""
        whole = pc.match_substring_regex(column, _OTHER_SPACE).to_numpy(zero_copy_only=False)
        uneven = pc.match_substring_regex(column, _UNEVEN).to_numpy(zero_copy_only=False)
        # Even texts: a first piece, and pieces after a space.  Others: chunks with the white space ahead of them.
        even, others = np.flatnonzero(~whole & ~uneven), np.flatnonzero(~whole & uneven)
        if len(even):
            split = pc.split_pattern(column.take(pa.array(even)), " ")
            edges = split.offsets.to_numpy().astype(np.int64)
            # An even text has a first piece even where it is empty.
            spaced = np.ones(edges[-1] - edges[0], dtype=bool)
            spaced[edges[:-1] - edges[0]] = False
            self._share(out, places[even], *self._expanded(split.flatten(), spaced), edges - edges[0])
        if len(others):
            split = [_CHUNK.findall(t) for t in column.take(pa.array(others)).to_pylist()]
            edges = np.r_[0, np.cumsum([len(cs) for cs in split])]
            chunks = pa.array(list(chain.from_iterable(split)), type=pa.string())
            self._share(out, places[others], *self._expanded(chunks, np.zeros(len(chunks), dtype=bool)), edges)
        for i in np.flatnonzero(whole).tolist():
            out[places[i]] = np.array(self._whole([column[i].as_py()])[0], dtype=np.int32)

    def _share(self, out: list, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray, edges: np.ndarray) -> None:
        """Put the ids of each row's chunks (``edges`` tell where they begin) into ``out``."""
        ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)[edges].tolist()
        for row, a, b in zip(rows.tolist(), ends, ends[1:], strict=False):
            out[row] = ids[a:b]


def _strings(column: pa.Array) -> list[str]:
    # Quicker than to_pylist, which makes a scalar of every value.
    return column.to_numpy(zero_copy_only=False).tolist()


def _pieces(lower: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What lies between white space, cut again where a mark follows a letter; and how many pieces lie before each text and in all."""
    bounds = np.frombuffer(lower.buffers()[1], dtype=np.int32)[lower.offset : lower.offset + len(lower) + 1]
    octets = np.frombuffer(lower.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    kinds = _KINDS[octets]
    space = kinds == 1
    begins = np.zeros(len(octets) + 1, dtype=bool)
    begins[1:] = space
    marks = np.flatnonzero(kinds == 2)
    last, before = octets[marks - 1], octets[np.maximum(marks - 2, 0)]
    # Two bytes of a letter from U+00C0 to U+024F, but for the signs of multiplication and division.
    latin = (last >= 0x80) & (last < 0xC0) & (before >= 0xC3) & (before <= 0xC9)
    latin &= (before != 0xC3) | ((last != 0x97) & (last != 0xB7))
    begins[marks[(kinds[marks - 1] == 3) | latin]] = True
    begins[bounds] = True
    begins = begins[:-1] & ~space
    starts = np.r_[np.flatnonzero(begins[~space]), np.count_nonzero(~space)].astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(octets[~space]))
    return pieces, np.searchsorted(np.flatnonzero(begins), bounds)


def _runs(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``values[first : first + n]`` of every pair, one after the other."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first - (ends - n), n) + np.arange(total)]


def id_type(path: str, end_id: int) -> str:
    """The numpy type that ids are stored in: two bytes where the whole vocabulary fits them."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


_tokenizers: dict[str, ChunkTokenizer] = {}


def _batches(texts: list[str], most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about this many characters together."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= most_chars:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def id_mapper(
    path: str, end_id: int, shape: Callable[[list[np.ndarray]], tuple[np.ndarray, list[pa.Array], list[str]]]
):
    """A ``mapInArrow`` function over ``_row`` (a struct of carried columns) and ``_text``.

    Every text's ids, ``end_id`` appended, go to ``shape``, which returns the
    row each output row comes from, and the output's columns and names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = ChunkTokenizer(path)
        tokenizer = _tokenizers[path]
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            for start, end in _batches(texts):
                ids = [np.append(x, np.int32(end_id)) for x in tokenizer.encode(texts[start:end])]
                rows, columns, names = shape(ids)
                carried = batch.column("_row").slice(start, end - start).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([carried, *columns], names=["_row", *names])

    return run


def with_row(docs: DataFrame, carry: list[str], text_col: str) -> tuple[DataFrame, str]:
    """``_row`` and ``_text`` of the documents, and the schema text of ``_row``."""
    frame = docs.select(F.struct(*[F.col(c) for c in carry]).alias("_row"), F.col(text_col).alias("_text"))
    return frame, "_row " + frame.schema["_row"].dataType.simpleString()
