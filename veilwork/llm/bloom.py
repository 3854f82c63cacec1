"""Bloom filters of 64-bit hashes, built in segments by Spark tasks.

A filter has a power of two of bits, cut into segments of ``SEGMENT_BITS``; a hash picks its
segment by its top bits and three bits in it by its low 32 bits.  Tasks send those of the distinct
hashes of each segment, packed, four bytes each, to the one task that fills the segment's bits; no rows move and
a frequent hash is sent once a task.  Only the finished bits come to the driver and are broadcast,
at most ``MAX_BITS`` (32 MB) of them.  A corpus that would need more bits gets a fuller filter:
more hashes then pass it, none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT_BITS = 1 << 17
MAX_BITS = 1 << 28
BITS_PER_HASH = 16
_FLUSH = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def filter_bits(n_hashes: int) -> int:
    """The number of bits for so many hashes."""
    need = max(SEGMENT_BITS, n_hashes * BITS_PER_HASH)
    return min(MAX_BITS, 1 << (int(need) - 1).bit_length())


def _segment(h: np.ndarray, bits: int) -> np.ndarray:
    top = (bits // SEGMENT_BITS).bit_length() - 1
    return (h >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(h), np.int64)


def _probes(low: np.ndarray) -> list[np.ndarray]:
    """Places in a segment from the low 32 bits of hashes: both ends of them, and a product's upper end."""
    return [(x & np.uint32(SEGMENT_BITS - 1)).astype(np.int64) for x in (low, low >> np.uint32(15), low * np.uint32(0x9E3779B1) >> np.uint32(15))]


class Filter:
    """A finished filter; ``words`` are its bytes."""

    def __init__(self, bits: int, segments: dict[int, bytes]):
        self.bits = bits
        self.bytes = np.zeros(bits // 8, np.uint8)
        for k, content in segments.items():
            at = k * (SEGMENT_BITS // 8)
            self.bytes[at : at + SEGMENT_BITS // 8] = np.frombuffer(content, np.uint8)

    def test(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the filter; never false for one that is."""
        base = _segment(h, self.bits) * SEGMENT_BITS
        out = np.ones(len(h), bool)
        for p in _probes(h.astype(np.uint32)):
            at = base + p
            out &= (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _packed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    kept: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        h = np.concatenate(kept)
        values, counts = np.unique(_segment(h, bits).astype(np.uint64) << np.uint64(32) | h & _LOW, return_counts=True)
        segment, low = (values >> np.uint64(32)).astype(np.int64), values.astype(np.uint32)
        cuts = np.flatnonzero(np.diff(segment, prepend=-1))
        rows = [(int(segment[a]), low[a:b], low[a:b][counts[a:b] > 1]) for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
            names=["segment", "once", "again"],
        )

    for batch in batches:
        h = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
        if len(h):
            kept.append(h)
            held += len(h)
        if held >= _FLUSH:
            yield flush()
            kept, held = [], 0
    if kept:
        yield flush()


def _filled(batches: Iterator[pa.RecordBatch], repeated: bool) -> Iterator[pa.RecordBatch]:
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}

    def put(bits: np.ndarray, low: np.ndarray) -> None:
        for p in _probes(low):
            bits[p] = True

    for batch in batches:
        for segment, new, again in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            low = np.frombuffer(new, np.uint32)
            seen = once.setdefault(segment, np.zeros(SEGMENT_BITS, bool))
            if repeated:
                a, b, c = _probes(low)
                found = np.concatenate((low[seen[a] & seen[b] & seen[c]], np.frombuffer(again, np.uint32)))
                if len(found):
                    put(twice.setdefault(segment, np.zeros(SEGMENT_BITS, bool)), found)
            put(seen, low)
    done = twice if repeated else once
    for segment, bits in done.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])


def build(hashes: DataFrame, n_hashes: int, repeated: bool) -> Filter:
    """The filter of a frame of one long column.

    ``repeated`` keeps only what was seen before: while a segment's first filter is filled, a
    hash that it already holds goes into a second one, and the second is returned.
    """
    bits = filter_bits(n_hashes)
    sent = hashes.mapInArrow(lambda it: _packed(it, bits), "segment long, once binary, again binary")
    # a task fills at most about 16 segments at a time (2 MB of flags)
    parts = max(1, bits // SEGMENT_BITS // 16)
    filled = sent.repartition(parts, "segment").mapInArrow(lambda it: _filled(it, repeated), "segment long, bits binary")
    return Filter(bits, {r["segment"]: bytes(r["bits"]) for r in filled.collect()})
