"""Word-shingle sets of whole texts as 64-bit hashes, computed a text at a time with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from toplist.llm.anchors import mix

# Distinct words remembered per worker before the table starts afresh (speed only).
REMEMBERED_WORDS = 100_000
# Texts whose sets are held at a time (memory only).
TEXTS_AT_ONCE = 1_000
# Fixed value: odd 64-bit multiplier of the positions inside a shingle.
STEP = 0xD6E8FEB86659FD93

_MASK = (1 << 64) - 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a UTF-8 text (A-Z lower-cased).

    Words are runs of other than space and ``\\t``-``\\r``, which is what
    ``bytes.split`` separates.  A text of fewer words has its whole sequence as
    its one shingle; one without words has none.
    """
    words = text.lower().split() if text else ()
    if not words:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        total += h[i : i + n] * np.uint64(pow(STEP, i + 1, 1 << 64))
    return np.unique(mix(total).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def set_mapper(
    size: int, whole: int | None, keep: int, carried: list[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: the columns ``carried``, ``set_hash``, ``n_shingles`` and ``shingles``.

    ``shingles`` holds all hashes of a set of up to ``whole`` (``None``: of any
    set) and otherwise the ``keep`` smallest, the bottom-k sketch, ascending.
    ``set_hash`` names the whole set (null for an empty one).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, TEXTS_AT_ONCE):
                batch = whole_batch.slice(start, TEXTS_AT_ONCE)
                sets = [shingle_set(t.as_py(), size) for t in batch.column("_text")]
                names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in carried],
                        pa.array(names, type=pa.binary()),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        _lists([s if whole is None or len(s) <= whole else s[:keep] for s in sets]),
                    ],
                    names=[*carried, "set_hash", "n_shingles", "shingles"],
                )

    return run
