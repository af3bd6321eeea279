"""Line dedup: lines that many documents share stay in one of them.

Two Bloom filters, of keys seen once and of keys seen twice, are built in one
pass over the texts. Only keys that the twice-seen filter suspects are shuffled,
as 128-bit digests with their documents, to be counted exactly and to choose the
document that keeps the line. Counts are partial aggregates, so a line held by a
third of all documents is a few rows per task. Texts move once, by doc_id, to meet
the list of the document's own dropped keys; lines are cut in built-in functions.

Defined cases: a null or empty text is one empty line; a null doc_id is one
document, the smallest; rows that share a doc_id are one document when lines are
counted; lines without a long enough key stay; columns named n_lines, n_dropped
in the input are replaced, all others are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import support as S

LEAST_CHARS, LEAST_DOCS = 40, 5
_SPACES = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINES = S.byte_table(0x0A)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _LOWER)


def _long_keys(buf: np.ndarray, at: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; rows, starts and ends of the stripped lines of enough code points."""
    low = S.lower_ascii(buf)
    word_starts, word_ends, _ = S.word_bounds(low, at)
    starts, ends, bounds = S.word_bounds(low, at, _LINES)
    rows = S.row_of(bounds)
    first, last = np.searchsorted(word_starts, starts), np.searchsorted(word_ends, ends, "right") - 1
    lit = first <= last
    rows, starts, ends = rows[lit], word_starts[first[lit]], word_ends[last[lit]]
    heads = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    enough = heads[ends] - heads[starts] >= least_chars
    return low, rows[enough], starts[enough], ends[enough]


def _once_per_row(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the first line of each key in each row."""
    return np.unique(S.mix64(hashes + S.mix64(rows.astype(np.uint64) + np.uint64(1))), return_index=True)[1]


def suspects(docs: DataFrame, *, least_chars: int = LEAST_CHARS, log_bits: int = bloom.LOG_BITS) -> DataFrame:
    """(doc_id, key) of the keys that the twice-seen filter holds; keys are 128-bit digests."""
    texts = docs.select("text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, buf, at in S.slices(batches, "text"):
            low, rows, starts, ends = _long_keys(buf, at, least_chars)
            found = S.span_hashes(low, starts, ends)
            yield found[_once_per_row(rows, found)]

    twice = docs.sparkSession.sparkContext.broadcast(bloom.build(texts, hashes, "twice", log_bits))
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in S.slices(batches, "text"):
            low, rows, starts, ends = _long_keys(buf, at, least_chars)
            found = S.span_hashes(low, starts, ends)
            first = _once_per_row(rows, found)
            first = first[twice.value.test(found[first])]
            data = low.tobytes()
            keys = [hashlib.md5(data[starts[i] : ends[i]]).digest() for i in first.tolist()]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[first])), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, key binary")


def repeated_lines(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """key, n_docs and keeper (the largest doc_id) of the keys in enough documents; exact."""
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= least_docs)


def dedup_lines(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, log_bits: int = bloom.LOG_BITS) -> DataFrame:
    """docs with the kept lines as text, and n_lines (before) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    S.small_batches(docs.sparkSession)
    found = S.staged(suspects(docs, least_chars=least_chars, log_bits=log_bits).distinct(), "line-suspects")
    bad = repeated_lines(found, least_docs)
    drops = (
        found.join(bad.select("key", "keeper"), "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("_line_doc"))
        .agg(F.collect_list("key").alias("_line_drops"))
    )
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.filter(lines, lambda x: (F.length(line_key(x)) < least_chars) | ~F.array_contains(F.col("_line_drops"), F.unhex(F.md5(line_key(x).cast("binary")))))
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops["_line_doc"]), "left").withColumn("_line_kept", F.when(F.col("_line_drops").isNotNull(), kept))
    n_lines, left = F.size(lines).cast("long"), F.col("_line_kept")
    return joined.select(
        *[F.when(left.isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        n_lines.alias("n_lines"),
        F.when(left.isNotNull(), n_lines - F.size(left)).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )


ORACLE = r"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM doc),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
bad AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, b.key IS NOT NULL AND k.doc_id <> b.keeper AS dropped FROM keyed k LEFT JOIN bad b ON k.key = b.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
