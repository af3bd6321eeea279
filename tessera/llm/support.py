"""What the corpus operators share: staged tables and a vectorised word kernel.

Inside a task the text of an Arrow batch is handled as one byte buffer; word
bounds, 64-bit word hashes and n-gram hashes are numpy expressions over it.
Batches are cut into slices of a few hundred kilobytes, so memory follows the
longest single document and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import delete_path, discard, scratch_path, shared_dir, staged

__all__ = ["delete_path", "discard", "release", "scratch_path", "shared_dir", "small_batches", "staged", "trim"]

SLICE_BYTES = 1 << 19
_U = np.uint64
_R, _R_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_G, _G_INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


# ---------------------------------------------------------------- staged tables


def row_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """Tells rows apart that share a doc_id but not a text; equal rows stay equal."""
    return F.xxhash64(F.col(doc_id), F.col(text))


BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, which else holds up to 64 MiB in the JVM and again in the Python worker; a value of the user's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == "67108864b":
        spark.conf.set(key, BATCH_BYTES)


def release(*shared: Broadcast) -> None:
    """Drop broadcast values that no later job will ask for."""
    for value in shared:
        value.destroy()


def trim() -> None:
    """Hand the memory that a task has freed back to the system: Python workers stay and serve later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# ---------------------------------------------------------------- Arrow slices


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' bounds in them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, bounds, data = texts.buffers()
    if len(texts) == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(bounds, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most `limit` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, at = buffer_of(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), buf[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
    trim()


# ---------------------------------------------------------------- hashing


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """r**i and r**-i modulo 2**64, grown on demand."""

    def __init__(self, r: int, inverse: int):
        self.r, self.inverse, self.up, self.down = r, inverse, np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            full = np.full(max(n, 1 << 16), self.r, _U)
            full[0] = 1
            self.up = np.multiply.accumulate(full)
            full[1:] = self.inverse
            self.down = np.multiply.accumulate(full)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_R, _R_INV), _Powers(_G, _G_INV)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf).astype(np.uint8)


def byte_table(*separators: int) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Bytes of a word [^\x20\x09-\x0D]+, of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ and of a line.
SPACED = byte_table(0x20, *range(0x09, 0x0E))
ALPHANUMERIC = byte_table(*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))


def word_bounds(buf: np.ndarray, at: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and each row's bounds among the words."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = table[buf]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    starts[edge] |= inside[edge + 1]
    ends[edge - 1] |= inside[edge]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """64-bit hashes of spans of bytes, given in order; done in blocks of spans."""
    out, i, n = np.empty(len(starts), _U), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + block)))
        base, top = starts[i], ends[j - 1]
        up, down = _BYTES.get(int(top - base) + 1)
        sums = np.zeros(top - base + 1, _U)
        np.cumsum((buf[base:top].astype(_U) + _U(1)) * up[:-1], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(_U))
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, over the bounds of rows too (see gram_starts)."""
    if len(words) < n:
        return np.zeros(0, _U)
    up, down = _WORDS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix64((sums[n:] - sums[:-n]) * down[: len(words) - n + 1] + _U(n))


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each word, its row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def gram_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions of the words at which a run of n words of one row starts."""
    rows = row_of(bounds)
    at = np.arange(len(rows))
    return at[at + n <= bounds[1:][rows]] if len(rows) else at


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + lengths, n), -1)
    return np.cumsum(steps[:-1]) > 0


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for every span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (leftmost on ties) of every `width` neighbouring hashes."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, reach = np.arange(len(grams)), 1
    while reach < width:  # doubling; the last step overlaps
        step = min(reach, width - reach)
        left, right = place[:-step], place[step:]
        place = np.where(grams[right] < grams[left], right, left)
        reach += step
    return place[:n]


def run_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of runs of words of any length; equal to gram_hashes for runs of n."""
    up, down = _WORDS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix64((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(_U))


def int_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an array<int> column and the rows' counts; a null is an empty list."""
    counts = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    return np.array(column.flatten(), np.int64), counts
