"""Vectorised words, lines and hashes of whole text columns, for use inside Arrow tasks.

A batch of texts is one byte buffer with offsets.  Words are runs of bytes other than space and
0x09-0x0D, which on UTF-8 is the same as runs of such characters.  Batches are cut into pieces
of about ``PIECE`` bytes, so that the helper arrays stay small however long a batch is; one
text is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a lane
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LONG = 512  # bytes from which a span is hashed by BLAKE2b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs only give equal outputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _turned(x: np.ndarray) -> np.ndarray:
    return x << np.uint64(29) | x >> np.uint64(35)


@dataclass
class Piece:
    """Some texts: their bytes, text borders, and the word spans, all as positions in ``data``."""

    data: np.ndarray
    offsets: np.ndarray  # of texts, one more than texts
    starts: np.ndarray  # of words
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than texts
    rows: slice  # the rows of the batch

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte flag over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans.

        A span goes eight bytes at a time through two states that are mixed after each step, so that
        no regular pattern cancels out; spans of up to eight bytes of one length never share a hash.
        """
        sizes = ends - starts
        lanes = np.ndarray(len(self.data) + 1, np.uint64, self.padded(), strides=(1,))  # eight bytes from each place
        rest = np.minimum(sizes, 8)
        one = mix((lanes[starts] & _KEEP[rest]) + sizes.astype(np.uint64) * _FIRST)
        at = np.flatnonzero((sizes > 8) & (sizes <= LONG))
        if len(at):
            first, second, place, left = one[at], one[at] * _SECOND, starts[at] + 8, sizes[at] - 8
            while len(at):
                lane = lanes[place] & _KEEP[np.minimum(left, 8)]
                first, second = mix(first ^ lane), mix(_turned(second) + lane * _FIRST)
                done = left <= 8
                if done.any():
                    one[at[done]] = mix(first[done] + _turned(second[done]))
                    at, first, second, place, left = (x[~done] for x in (at, first, second, place, left))
                place, left = place + 8, left - 8
        content = self.data
        for k in np.flatnonzero(sizes > LONG).tolist():
            digest = hashlib.blake2b(content[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
            one[k] = int.from_bytes(digest, "little")
        return one

    def padded(self) -> np.ndarray:
        """The bytes with zeros behind them, so that eight bytes can be read from any place."""
        return np.concatenate((self.data, np.zeros(8, np.uint8)))


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[data]
    start, end = word.copy(), word.copy()
    if len(data):
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]  # texts touch in the buffer
        start[at] = word[at]
        end[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = word[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; null counts as empty."""
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, lower: bool = False) -> Iterator[Piece]:
    """The texts of a column piece by piece; ``lower`` lower-cases A-Z only."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        own, places = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, ends = _spans(own, places)
        yield Piece(own, places, starts, ends, np.searchsorted(starts, places), slice(at, to))
        at = to


def grams(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and the index of each run's first word."""
    total = len(hashes)
    if total < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: total - size + 1] == text[size - 1 :])
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[at + k]
    return mix(out), at
