"""Substring dedup by relative Lempel-Ziv parsing.

Every document is parsed into factors against an index of all documents. The
index holds reference blocks: of each window of `window` words the smallest hash
of its `gram`-word runs is the anchor, neighbouring windows with one anchor form
a block, and a block is known by its anchor and by the hash of all its words.
Equal windows have equal anchors, so they lie in blocks of one anchor.

1. Equal blocks are found by anchor and block hash; a group of copies is one
   index entry with a count and its first and last place.
2. Where anchors agree but blocks differ, one block of each kind is opened into
   its windows, and equal windows are index entries in the same way.
3. Each document is parsed with what the index has at its positions: from the
   first position that matches, the longest of the matches is a factor, and the
   parse goes on behind it. A match is followed through the blocks and windows
   after it at every place of an entry with up to PLACES of them, else at the
   first and the last one. A position is never its own reference, but a text that
   several rows share may refer to the same place, which is another row's. Windows
   that lie across the end of a factor are checked by themselves. Factors and such
   windows are the duplicate spans.

Anchors that a Bloom filter of fixed size has not seen twice cannot start a
factor and are never shuffled; a second filter names the blocks that step 2 opens.

Defined cases: a null text has no words; two rows equal in id and text are two
documents, each a copy of the other; texts shorter than a window stay; windows
are judged on the input; n_words, n_removed, n_factors in the input are replaced
and all other columns carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from . import support as S

WINDOW, GRAM = 35, 12
#: Places of an index entry that are all followed; of more, the first and the last one are.
PLACES = 8


def _blocks(words: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of every reference block."""
    starts = S.gram_starts(bounds, window)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    grams = S.gram_hashes(words, gram)
    anchors = S.minima(grams, window - gram + 1)[starts]
    first = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return grams[anchors[first]], starts[first], np.diff(np.append(first, len(starts)))


def _words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = S.word_bounds(buf, at)
    return S.span_hashes(buf, starts, ends), bounds


def _place_hash(row_keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return S.mix64(row_keys.view(np.uint64) + S.mix64(starts.astype(np.uint64)))


def reference_index(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, log_bits: int = bloom.LOG_BITS) -> DataFrame:
    """(doc_id, row_key, anchor, block, start, n) of all blocks whose anchor may stand twice in the corpus."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, buf, at in S.slices(batches, "text"):
            yield _blocks(*_words(buf, at), window, gram)[0]

    twice = docs.sparkSession.sparkContext.broadcast(bloom.build(docs.select("text"), anchors, "twice", log_bits))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in S.slices(batches, "text"):
            words, bounds = _words(buf, at)
            anchor, starts, n = _blocks(words, bounds, window, gram)
            hit = twice.value.test(anchor)
            anchor, starts, n = anchor[hit], starts[hit], n[hit]
            rows = S.row_of(bounds)[starts]
            columns = [part.column(k).take(pa.array(rows)) for k in (0, 1)]
            columns += [pa.array(S.signed(anchor)), pa.array(S.signed(S.run_hashes(words, starts, n + window - 1))), pa.array((starts - bounds[rows]).astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "anchor", "block", "start", "n"])

    return docs.select("doc_id", S.row_key().alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key long, anchor long, block long, start int, n int")


def boundary_windows(docs: DataFrame, opened: DataFrame, *, window: int = WINDOW, gram: int = GRAM, log_bits: int = bloom.LOG_BITS) -> DataFrame:
    """(doc_id, row_key, anchor, hash, start) of the single windows of the opened blocks (row_key, start)."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield _place_hash(np.array(batch.column(0)), np.array(batch.column(1)))

    named = docs.sparkSession.sparkContext.broadcast(bloom.build(opened.select("row_key", "start"), places, "once", log_bits))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in S.slices(batches, "text"):
            words, bounds = _words(buf, at)
            anchor, starts, n = _blocks(words, bounds, window, gram)
            rows = S.row_of(bounds)[starts]
            hit = named.value.test(_place_hash(np.array(part.column(1))[rows], starts - bounds[rows]))
            anchor, starts, n, rows = (x[hit] for x in (anchor, starts, n, rows))
            single, rows = S.ranges(starts, n), np.repeat(rows, n)
            columns = [part.column(k).take(pa.array(rows)) for k in (0, 1)]
            columns += [pa.array(S.signed(np.repeat(anchor, n))), pa.array(S.signed(S.run_hashes(words, single, np.full(len(single), window)))), pa.array((single - bounds[rows]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "anchor", "hash", "start"])

    return docs.select("doc_id", S.row_key().alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key long, anchor long, hash long, start int")


def _entries(places: DataFrame, *keys: str) -> DataFrame:
    """What stands at more than one place, with its count and its first and last place."""
    place = F.struct("row_key", "start")
    return places.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), F.min(place).alias("first"), F.max(place).alias("last"))


def _references(places: DataFrame, entries: DataFrame, *keys: str) -> DataFrame:
    """(keys, refs): the places at which entries that stand more than once are followed."""
    few = entries.where(F.col("seen").between(2, PLACES)).select(*keys)
    every = places.join(few, list(keys)).groupBy(*keys).agg(F.collect_set(F.struct("row_key", "start")).alias("refs"))
    return every.unionByName(entries.where(F.col("seen") > PLACES).select(*keys, F.array("first", "last").alias("refs")))


def matches(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, log_bits: int = bloom.LOG_BITS) -> DataFrame:
    """(doc_id, row_key, start, n, refs): n windows from `start` on that stand more than once, and places (row_key, start) of them, their own included.

    Staged: the joins that a hot block or window goes through end in a plain
    write, so that their large partitions can be split.
    """
    index = S.staged(reference_index(docs, window=window, gram=gram, log_bits=log_bits), "reference-index")
    blocks = S.staged(_entries(index, "anchor", "block"), "reference-blocks")
    differing = blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    opened = blocks.join(differing.select("anchor"), "anchor", "left_semi").select("first.row_key", "first.start")
    single = S.staged(boundary_windows(docs, opened, window=window, gram=gram, log_bits=log_bits), "boundary-windows")
    twice = S.staged(_entries(single, "anchor", "hash").where("seen > 1"), "windows-seen-twice")
    columns = ["doc_id", "row_key", "start", "n", "refs"]
    whole = index.join(_references(index, blocks, "anchor", "block"), ["anchor", "block"]).select(*columns)
    parts = single.join(_references(single, twice, "anchor", "hash"), ["anchor", "hash"]).withColumn("n", F.lit(1)).select(*columns)
    found = S.staged(whole.unionByName(parts), "matches")
    S.discard(index, blocks, single, twice)
    return found


def parse(starts: np.ndarray, counts: np.ndarray, keys: np.ndarray, places: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, key and place of the reference) of one document, then the matching windows across their ends (key and place 0).

    Match k says that `counts[k]` windows from `starts[k]` on also start at
    places[k] and behind it in the document keys[k].
    """
    if not len(starts):
        return []
    # one row for each window and reference, ordered by reference and by distance to it: rows that go on are neighbours
    step = S.ranges(np.zeros(len(counts), np.int64), counts)
    own, key, place = np.repeat(starts, counts) + step, np.repeat(keys, counts), np.repeat(places, counts) + step
    order = np.lexsort((own, place - own, key))
    own, key, place = own[order], key[order], place[order]
    goes_on = (own[1:] == own[:-1] + 1) & (key[1:] == key[:-1]) & (place[1:] == place[:-1] + 1)
    again = (own[1:] == own[:-1]) & (key[1:] == key[:-1]) & (place[1:] == place[:-1])
    last = np.flatnonzero(np.concatenate([~(goes_on | again), [True]]))
    reach = own[last[np.searchsorted(last, np.arange(len(own)))]]  # the last window of the match that goes through this row
    best = np.lexsort((-reach, own))
    own, reach, key, place = own[best], reach[best], key[best], place[best]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    own, reach, key, place = own[first], reach[first], key[first], place[first]
    factors, across, i = [], [], 0
    while i < len(own):
        end = int(reach[i]) + window
        factors.append((int(own[i]), end - int(own[i]), int(key[i]), int(place[i])))
        i = int(np.searchsorted(own, end))
        straddling = own[np.searchsorted(own, end - window, "right") : i]
        across += [(int(x), window, 0, 0) for x in straddling]
    return factors + across


def _cut(buf: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and bounds of the kept words joined by one space, and each row's counts of words and of removed words."""
    first, last, bounds = S.word_bounds(buf, at)
    gone = S.covered(np.repeat(bounds[:-1], counts) + starts, lengths, len(first))
    rows = S.row_of(bounds)
    kept, own = np.flatnonzero(~gone), rows[~gone]
    follows = np.concatenate([own[1:] == own[:-1], [False]]) if len(own) else np.zeros(0, bool)
    # a word that another one of its row follows takes the separator after it along, as a space
    steps = np.zeros(len(buf) + 2, np.int64)
    np.add.at(steps, first[kept], 1)
    np.add.at(steps, last[kept] + follows, -1)
    taken = np.cumsum(steps[: len(buf)]) > 0
    out = buf.copy()
    out[last[kept][follows]] = 0x20
    sizes = np.concatenate([[0], np.cumsum(taken)])[at]
    return out[taken], sizes, np.diff(bounds), np.bincount(rows[gone], minlength=len(at) - 1)


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, log_bits: int = bloom.LOG_BITS) -> DataFrame:
    """docs with the kept words, joined by one space, as text, and n_words, n_removed, n_factors.

    The matches of a document meet its text by id and row key; a document's list
    is bounded by its own words.
    """
    docs = docs.drop("n_words", "n_removed", "n_factors")
    S.small_batches(docs.sparkSession)
    found = matches(docs, window=window, gram=gram, log_bits=log_bits)
    # rows of one id and text: each is a copy of the other, at the same place
    shared = docs.groupBy(S.row_key().alias("row_key")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("row_key", F.lit(True).alias("_shared"))
    followed = found.join(shared, "row_key", "left").withColumn("_ref", F.explode("refs")).where(F.col("_shared") | (F.col("_ref.row_key") != F.col("row_key")) | (F.col("_ref.start") != F.col("start")))
    fields = F.struct("start", "n", F.col("_ref.row_key").alias("key"), F.col("_ref.start").alias("place"))
    lists = followed.groupBy(F.col("row_key").alias("_match_key"), F.col("doc_id").alias("_match_id")).agg(F.collect_set(fields).alias("_m"))
    lists = lists.select("_match_key", "_match_id", *[F.col(f"_m.{k}").alias(f"_{k}s") for k in ("start", "n", "key", "place")])
    joined = docs.join(lists, (S.row_key() == F.col("_match_key")) & docs["doc_id"].eqNullSafe(F.col("_match_id")), "left").drop("_match_key", "_match_id")
    columns, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in S.slices(batches, "text"):
            (start, sizes), (n, _), (keys, _), (places, _) = (S.int_lists(part.column(len(columns) + k)) for k in range(4))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            spans, n_spans, n_factors = [], np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for i in np.flatnonzero(sizes).tolist():
                own = slice(ends[i], ends[i + 1])
                parsed = parse(start[own], n[own], keys[own], places[own], window)
                spans += parsed
                n_spans[i], n_factors[i] = len(parsed), sum(length > window or key != 0 for _, length, key, _ in parsed)
            starts, lengths = (np.array([x[k] for x in spans], np.int64) for k in (0, 1))
            data, bounds, n_words, n_removed = _cut(buf, at, starts, lengths, n_spans)
            text = pa.StringArray.from_buffers(len(part), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data.tobytes()))
            kept = [*part.columns[: len(columns)], pa.array(n_words.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(n_factors)]
            kept[place] = text
            yield pa.RecordBatch.from_arrays(kept, names=[*columns, "n_words", "n_removed", "n_factors"])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, T.LongType()) for k in ("n_words", "n_removed", "n_factors"))])
    return joined.mapInArrow(run, schema)
