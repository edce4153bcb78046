"""Byte-window hashing shared by the passes of the suffix-array dedup.

Every ``window``-byte string of a text is keyed at one *anchor*: the position
of the smallest ``gram``-byte hash inside it.  The choice depends on the
window's bytes alone, so equal windows choose the same anchor wherever they
stand.  All hashes are polynomial prefix hashes modulo 2**64 over a table of
random 64-bit byte codes, computed for a whole text at once.
"""

from __future__ import annotations

import numpy as np

# The odd multiplier of the rolling hash and the finalisers (64-bit mixing constants).
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
# Positions share a 64-bit word with the hash when the smallest is sought.
POSITION_BITS = 32

_MASK = (1 << 64) - 1
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, _MASK, size=256, dtype=np.uint64, endpoint=True
)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for ``i < n`` (grown by doubling, kept per worker)."""
    have = len(_powers.get("up", ()))
    if have < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX_1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(MIX_2)
    return h ^ (h >> np.uint64(33))


class Prefix:
    """Prefix hashes of one text: the hash of any byte range in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _power_table(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, q: int) -> np.ndarray:
        """Hash of the ``q`` bytes at every position that has as many."""
        last = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:last]) * self.down[:last])


def _sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by block-wise running minima from both ends."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, Prefix]:
    """Ascending anchor positions of all windows of a text (none when it is shorter than a window).

    Ties on the leading hash bits go to the leftmost position, which every
    copy of the window decides alike.
    """
    if len(data) < window:
        return np.empty(0, dtype=np.int64), None
    prefix = Prefix(data)
    low = np.uint64((1 << POSITION_BITS) - 1)
    keys = prefix.grams(gram) & ~low
    keys |= np.arange(len(keys), dtype=np.uint64)
    least = _sliding_min(keys, window - gram + 1) & low
    kept = np.empty(len(least), dtype=bool)
    kept[0] = True
    np.not_equal(least[1:], least[:-1], out=kept[1:])
    return np.unique(least[kept].astype(np.int64)), prefix


def window_hashes(
    contexts: np.ndarray, left: np.ndarray, window: int, reach: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that start 0 to ``reach`` bytes ahead of each context's anchor.

    ``contexts`` are byte strings with ``left`` bytes before the anchor.  Column
    ``d`` of both results is the window that starts ``d`` bytes ahead; the
    second result tells whether the context holds it.
    """
    width = reach + window
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    rows = np.zeros((len(contexts), width), dtype=np.uint8)
    flat = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    start = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(contexts)), sizes)
    # Contexts are lined up so that every anchor stands at column ``reach``.
    rows[row, np.arange(len(flat)) - start[row] + (reach - left)[row]] = flat
    up, down = _power_table(width + 1)
    sums = np.zeros((len(contexts), width + 1), dtype=np.uint64)
    np.cumsum(_BYTE_CODES[rows] * up[:width], axis=1, out=sums[:, 1:])
    d = np.arange(reach + 1)
    hashes = mix((sums[:, reach - d + window] - sums[:, reach - d]) * down[reach - d])
    after = sizes - left
    valid = (left[:, None] >= d) & (after[:, None] >= window - d)
    return hashes, valid
