"""Benchmark decontamination by winnowing.

Of every `window` consecutive words the smallest hash of the `gram`-word runs in
it is kept: two texts that share `window` words share a kept fingerprint. The
items' fingerprints form a Bloom filter of fixed size; document fingerprints
that pass are extended to the windows they stand for, whose hashes are joined
with the items' windows (Catalyst broadcasts that side while it is small, and
shuffles it otherwise). Items shorter than a window are one window; they are
winnowed with runs of their own length.

Defined cases: null texts have no words; a null item_id counts as the empty id;
rows of documents equal in id and text give equal rows; an item without words
has no window; empty tables give no hits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import support as S

WINDOW, GRAM = 10, 4
LOG_BITS = 24  # 2 MiB of item fingerprints


def _words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = S.lower_ascii(buf)
    starts, ends, bounds = S.word_bounds(low, at, S.ALPHANUMERIC)
    return S.span_hashes(low, starts, ends), bounds


def _fingerprints(words: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside rows, and the fingerprint of each."""
    starts = S.gram_starts(bounds, window)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    grams = S.gram_hashes(words, gram)
    return starts, grams[S.minima(grams, window - gram + 1)[starts]]


def item_windows(items: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(n, fingerprint, hash, items): every different window of the items, with the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in S.slices(batches, "text"):
            words, bounds = _words(buf, at)
            rows, sizes = S.row_of(bounds), np.diff(bounds)
            starts, prints = _fingerprints(words, bounds, window, gram)
            short = np.flatnonzero((sizes > 0) & (sizes < window))
            whole = S.run_hashes(words, bounds[short], sizes[short])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.concatenate([rows[starts], short]).astype(np.int64))),
                    pa.array(np.concatenate([np.full(len(starts), window), sizes[short]]).astype(np.int32)),
                    pa.array(S.signed(np.concatenate([prints, whole]))),
                    pa.array(S.signed(np.concatenate([S.run_hashes(words, starts, np.full(len(starts), window)), whole]))),
                ],
                names=["item_id", "n", "fingerprint", "hash"],
            )

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    found = named.mapInArrow(run, "item_id string, n int, fingerprint long, hash long")
    return S.staged(found.groupBy("n", "fingerprint", "hash").agg(F.collect_set("item_id").alias("items")), "item-windows")


def contaminated_windows(docs: DataFrame, windows: DataFrame, *, window: int = WINDOW, gram: int = GRAM, log_bits: int = LOG_BITS) -> DataFrame:
    """(doc_id, row_key, start, n, items): each place in a document where an item's window stands."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield np.array(batch.column(0)).view(np.uint64)

    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(bloom.build(windows.select("fingerprint"), prints, "once", log_bits))
    shorter = sorted(r.n for r in windows.select("n").where(F.col("n") < window).distinct().collect())  # fewer than `window` values
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in S.slices(batches, "text"):
            words, bounds = _words(buf, at)
            rows, found = S.row_of(bounds), []
            for n in [window, *shorter]:
                starts, kept = _fingerprints(words, bounds, n, gram if n == window else n)
                hit = known.value.test(kept)
                found.append((starts[hit], np.full(int(hit.sum()), n), kept[hit]))
            starts, lengths, kept = (np.concatenate(x) for x in zip(*found, strict=True))
            hashes = S.run_hashes(words, starts, lengths)
            own = pa.array(rows[starts])
            columns = [part.column(0).take(own), part.column(1).take(own), pa.array((starts - bounds[rows[starts]]).astype(np.int32)), pa.array(lengths.astype(np.int32)), pa.array(S.signed(kept)), pa.array(S.signed(hashes))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "start", "n", "fingerprint", "hash"])

    places = docs.select("doc_id", S.row_key().alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key long, start int, n int, fingerprint long, hash long")
    return places.join(windows, ["n", "fingerprint", "hash"]).select("doc_id", "row_key", "start", "n", "items")


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_words) per row, by the word bounds that the windows use."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in S.slices(batches, "text"):
            _, _, bounds = S.word_bounds(S.lower_ascii(buf), at, S.ALPHANUMERIC)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds).astype(np.int64))], names=["doc_id", "row_key", "n_words"])

    return docs.select("doc_id", S.row_key().alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key long, n_words long")


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, gram: int = GRAM, log_bits: int = LOG_BITS) -> DataFrame:
    """doc_id, row_key, n_words, n_hit, items (sorted ids), contaminated: a row per document."""
    S.small_batches(docs.sparkSession)
    hits = contaminated_windows(docs, item_windows(items, window=window, gram=gram), window=window, gram=gram, log_bits=log_bits)
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", F.col("n").alias("n")))),
        F.struct(F.lit(0).alias("n_hit"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n_hit"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(acc["end"], s["start"]))).alias("n_hit"), F.greatest(acc["end"], s["start"] + s["n"]).alias("end")),
    )
    per_doc = hits.groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(merged["n_hit"].cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = word_counts(docs).join(per_doc, (F.col("row_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "row_key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS key
  FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
place AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN lens WHERE len(w) >= n)),
hit AS (SELECT p.r, p.i, p.n, win.item_id FROM place p JOIN win ON p.n = win.n AND p.key = win.key),
word AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN word USING (r) LEFT JOIN item USING (r)
"""
