"""Bloom filters over all rows of a table, in segments that tasks merge.

A filter has a fixed number of bits, so what is broadcast has a proven bound
(`bits` / 8 bytes) whatever the input. Beyond the bits' capacity a filter only
lets more through; every operator confirms exactly what passes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .support import mix64

LOG_BITS = 27  # 16 MiB
PROBES = 3
SEGMENT = 23  # 2**23 bits, 1 MiB
_FEW = 1 << 20  # bits up to which a task holds numbers
SCHEMA = "segment int, once binary, twice binary"
_ARROW = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_FLUSH = 1 << 18


def positions(hashes: np.ndarray, log_bits: int, probe: int) -> np.ndarray:
    other = mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return (hashes + np.uint64(probe) * other) & np.uint64((1 << log_bits) - 1)


def pack(numbers: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, by byte planes."""
    steps = np.diff(numbers, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.cumsum(planes.reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def _lit(numbers: np.ndarray, size: int) -> np.ndarray:
    bits = np.zeros(size, bool)
    bits[numbers] = True
    return np.packbits(bits, bitorder="little")


class Segments:
    """Once-seen and twice-seen bits of what one task met; of "once" filters only the former.

    Few bits are held as sorted numbers, many as bitmaps by segment.
    """

    def __init__(self, log_bits: int, which: str = "twice"):
        self.log_bits, self.pairs, self.waiting, self.n = log_bits, which == "twice", [], 0
        self.few, self.held = [np.zeros(0, np.uint32) for _ in range(1 + self.pairs)], {}

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.n += len(hashes)
        if self.n >= _FLUSH:
            self.flush()

    def flush(self) -> None:
        if not self.n:
            return
        once, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.n = [], 0
        bits = [np.unique(np.concatenate([positions(h, self.log_bits, p) for p in range(PROBES)]).astype(np.uint32)) for h in (once, once[counts > 1])[: 1 + self.pairs]]
        if self.held or len(self.few[0]) + len(bits[0]) > _FEW:
            if not self.held:
                self._to_bitmaps(self.few)
                self.few = [x[:0] for x in self.few]
            self._to_bitmaps(bits)
            return
        if self.pairs:
            self.few[1] = np.union1d(np.union1d(self.few[1], bits[1]), np.intersect1d(self.few[0], bits[0], assume_unique=True))
        self.few[0] = np.union1d(self.few[0], bits[0])

    def _to_bitmaps(self, bits: list[np.ndarray]) -> None:
        size = 1 << min(SEGMENT, self.log_bits)
        for k in range(1 << max(0, self.log_bits - SEGMENT)):
            own = [_lit(_of_segment(x, k), size) for x in bits]
            pair = self.held.setdefault(k, [np.zeros(size >> 3, np.uint8) for _ in bits])
            if self.pairs:
                pair[1] |= own[1] | (pair[0] & own[0])
            pair[0] |= own[0]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        if not self.held:
            for k in range(1 << max(0, self.log_bits - SEGMENT)):
                own = [_of_segment(x, k) for x in self.few]
                if len(own[0]):
                    yield _row(k, [b"n" + pack(x) for x in own])
        for k in sorted(self.held):
            yield _row(k, [b"b" + zlib.compress(x.tobytes(), 1) for x in self.held.pop(k)])


def _of_segment(numbers: np.ndarray, k: int) -> np.ndarray:
    """Of sorted numbers, those of a segment, counted from its start."""
    a, b = np.searchsorted(numbers, (k << SEGMENT, (k + 1) << SEGMENT))
    return numbers[a:b] - np.uint32(k << SEGMENT)


def _row(segment: int, packed: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([x], pa.binary()) for x in packed]
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), columns[0], columns[1] if len(columns) > 1 else pa.nulls(1, pa.binary())], names=_ARROW.names)


def _bitmap(data: bytes, size: int) -> np.ndarray:
    return _lit(unpack(data[1:]), size) if data[:1] == b"n" else np.frombuffer(zlib.decompress(data[1:]), np.uint8)


class Bloom:
    """The merged bits, for membership tests inside tasks."""

    def __init__(self, bits: np.ndarray, log_bits: int):
        self.bits, self.log_bits = bits, log_bits

    def __contains__(self, hashes: np.ndarray) -> np.ndarray:
        raise TypeError("use test()")

    def test(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in range(PROBES):
            at = positions(hashes, self.log_bits, p)
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def build(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], which: str = "twice", log_bits: int = LOG_BITS) -> Bloom:
    """The filter of what `hashes` takes from df's batches: of everything ("once") or of what comes up twice ("twice").

    Tasks hand over compressed segments; they meet by segment, and the merged
    filter of at most 2**log_bits bits goes to the driver once.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Segments(log_bits, which)
        for found in hashes(batches):
            own.add(found)
        yield from own.rows()

    return merged(df.mapInArrow(scan, SCHEMA), which, log_bits)


def merged(segments: DataFrame, which: str = "twice", log_bits: int = LOG_BITS) -> Bloom:
    """The filter of the segments that tasks have made."""

    size = 1 << min(SEGMENT, log_bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for segment, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [_bitmap(x, size) for x in packed if x is not None]
                bits = held.setdefault(segment, [np.zeros(size + 7 >> 3, np.uint8) for _ in parts])
                if len(parts) > 1:
                    bits[1] |= parts[1] | (bits[0] & parts[0])
                bits[0] |= parts[0]
        for segment, bits in held.items():
            yield _row(segment, [b"b" + zlib.compress(x.tobytes(), 1) for x in bits])

    merge.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    bits = np.zeros((1 << log_bits) // 8, np.uint8)
    for row in segments.groupBy("segment").applyInArrow(merge, SCHEMA).select("segment", which).toLocalIterator():
        own = _bitmap(row[which], size)
        at = row["segment"] << (SEGMENT - 3)
        bits[at : at + len(own)] = own
    return Bloom(bits, log_bits)
