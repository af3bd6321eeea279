"""Quality rules by tokeniser fertility.

Two public vocabularies measure every text: characters per token (byte-level
BPE and piece BPE), the share of byte-fallback tokens (piece BPE) and the
entropy of the token distribution. A document is rejected when its base rules
fail or a measure leaves the band of its language, or of its script where the
language is unknown. Each distinct word is encoded once per cache: tokens of
these vocabularies do not cross white space, so a text's tokens are those of
its words, each encoded as it stands after one space.

Defined cases: a null or empty text has no words, all counts are 0, its base
rules fail (fewer than 10 words) and its measures are null; a null language
falls back to the script of most letters; equal rows give equal results, with
rows that share an id judged one by one; short texts have wider bands; input
columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support as S

TOKENIZERS = "/opt/tokenizers"
PIECE_MODEL, BYTE_RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: The byte-level vocabulary's own split into words, digits and marks.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CACHE_WORDS = 100_000
SHINGLE = 5


#: Rows of labelled documents that fit() takes at most.
SAMPLE_ROWS = 20_000
#: What a band leaves below its centre whatever the length, and the share of good documents that it must hold.
MARGIN, HELD = 0.02, 0.999
#: No prose of the four languages has more characters per token in these vocabularies.
MOST_PIECE_CHARS, MOST_BYTE_CHARS = 7.0, 7.5


@dataclass(frozen=True)
class Band:
    """Limits of a language or script; n is the number of tokens, and short texts scatter more.

    A measure may lie `MARGIN` + spread / sqrt(n) below its centre, up to its
    highest value; fallback may exceed its limit by 0.5 / sqrt(n); evenness is
    entropy over the highest of n tokens, and entropy itself may not be below
    `entropy` where n allows so much.
    """

    piece_centre: float
    piece_spread: float
    byte_centre: float
    byte_spread: float
    fallback: float
    evenness: float = 0.35
    entropy: float = 3.0


@dataclass(frozen=True)
class Bands:
    """Bands by language, then by script.

    Those of languages are fit()'s of the good documents with an even doc_id in a
    synthetic corpus of 10,000, with spreads raised by a quarter to a half so that
    unseen good documents stay (README); those of scripts are wide by choice.
    """

    by_language: dict[str, Band] = field(
        default_factory=lambda: {
            "en": Band(2.22, 6.5, 2.23, 3.7, 0.05),
            "de": Band(2.24, 8.5, 2.31, 6.0, 0.05),
            "fr": Band(1.98, 5.0, 2.04, 3.7, 0.05),
            "es": Band(1.94, 4.5, 2.06, 3.7, 0.05),
        }
    )
    by_script: dict[str, Band] = field(default_factory=lambda: {"latin": Band(1.5, 8.0, 1.5, 8.0, 0.1), "other": Band(0.4, 8.0, 0.4, 8.0, 0.7)})


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_letters long, n_ascii_letters long, piece_tokens long, byte_tokens long, fallback_tokens long, token_entropy double"
)


class Fertility:
    """Token statistics of distinct words, kept up to CACHE_WORDS words."""

    def __init__(self, piece_model: bytes, byte_ranks: bytes):
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in byte_ranks.splitlines() if line)}
        self.byte_bpe = tiktoken.Encoding("multi", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece_bpe = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.is_byte = np.array([self.piece_bpe.is_byte(i) for i in range(self.piece_bpe.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.start, self.length, self.n_byte_bpe, self.n_fallback = (np.empty(CACHE_WORDS * 2, np.int64 if k == 0 else np.int32) for k in range(4))

    def lookup(self, hashes: np.ndarray, word_at) -> np.ndarray:
        """Cache places of the words with these distinct hashes; word_at gives the words at some of the places."""
        if len(self.known) > CACHE_WORDS or len(self.known) + len(hashes) > len(self.start):
            self.clear()
            if len(hashes) > len(self.start):
                self.start, self.length, self.n_byte_bpe, self.n_fallback = (np.empty(len(hashes) * 2, a.dtype) for a in (self.start, self.length, self.n_byte_bpe, self.n_fallback))
        keys = hashes.tolist()
        places = np.array([self.known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(places < 0)
        if len(new):
            words = word_at(new)
            pieces = self.piece_bpe.encode(words, num_threads=1)
            first = len(self.known)
            for k, (i, ids, word) in enumerate(zip(new.tolist(), pieces, words, strict=True), first):
                self.known[keys[i]] = k
                self.length[k] = len(ids)
                self.n_byte_bpe[k] = len(self.byte_bpe.encode_ordinary(" " + word))
            own = np.fromiter((t for ids in pieces for t in ids), np.int32)
            if self.used + len(own) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(own), len(self.flat)), np.int32)])
            self.flat[self.used : self.used + len(own)] = own
            lengths = self.length[first : first + len(new)]
            ends = np.cumsum(lengths)
            self.start[first : first + len(new)] = self.used + ends - lengths
            fallen = np.concatenate([[0], np.cumsum(self.is_byte[own])])
            self.n_fallback[first : first + len(new)] = fallen[ends] - fallen[ends - lengths]
            self.used += len(own)
            places[new] = np.arange(first, first + len(new))
        return places


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over each row's stretch of values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _earlier_equal(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the same hash stands earlier in the same row."""
    key = S.mix64(hashes + S.mix64(rows.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    out = np.ones(len(key), bool)
    out[first] = False
    return out


def _found_twice(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    key = S.mix64(hashes + S.mix64(rows.astype(np.uint64) + np.uint64(1)))
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[back] > 1


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_LINES = S.byte_table(0x0A)
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def _measure(buf: np.ndarray, at: np.ndarray, fertility: Fertility) -> dict[str, np.ndarray]:
    n_rows = len(at) - 1
    starts, ends, bounds = S.word_bounds(buf, at)
    rows, n_words = S.row_of(bounds), np.diff(bounds)
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
    hashes = S.span_hashes(buf, starts, ends)
    out = {"n_words": n_words, "word_chars": _sums(heads[ends] - heads[starts], bounds), "n_symbols": _sums(_SYMBOLS[buf], at)}
    out["n_ascii_letters"] = _sums(_LETTERS[buf], at)
    out["n_letters"] = out["n_ascii_letters"] + _sums(buf >= 0xC0, at)

    lines, line_ends, line_bounds = S.word_bounds(buf, at, _LINES)
    lit = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)  # lines with a word
    line_rows = S.row_of(line_bounds)
    again = np.zeros(len(lines), bool)
    again[lit] = _earlier_equal(line_rows[lit], S.span_hashes(buf, lines[lit], line_ends[lit]))
    out["n_dup_lines"] = _sums(again, line_bounds)

    windows = S.gram_starts(bounds, SHINGLE)
    twice = windows[_found_twice(rows[windows], S.gram_hashes(hashes, SHINGLE)[windows])]
    out["n_repeat_words"] = _sums(S.covered(twice, np.full(len(twice), SHINGLE), len(hashes)), bounds)

    distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    data = buf.tobytes()
    places = fertility.lookup(distinct, lambda new: [data[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new].tolist()])[back]
    lengths = fertility.length[places].astype(np.int64)
    out["piece_tokens"], out["byte_tokens"], out["fallback_tokens"] = _sums(lengths, bounds), _sums(fertility.n_byte_bpe[places], bounds), _sums(fertility.n_fallback[places], bounds)
    tokens = fertility.flat[S.ranges(fertility.start[places], lengths)].astype(np.int64)
    key, counts = np.unique(np.repeat(rows, lengths) << 20 | tokens, return_counts=True)
    per_row = np.searchsorted(key, np.arange(n_rows + 1) << 20)
    n = np.maximum(out["piece_tokens"], 1)
    plogp = np.concatenate([[0.0], np.cumsum(counts * np.log2(counts))])
    entropy = np.log2(n) - (plogp[per_row[1:]] - plogp[per_row[:-1]]) / n
    out["token_entropy"] = np.where(out["piece_tokens"] > 0, np.maximum(entropy, 0.0), np.nan)
    return out


def measure(docs: DataFrame, *, tokenizers: str = TOKENIZERS, carry: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Base counts and fertility measures per row, with the columns in `carry`."""
    spark = docs.sparkSession
    S.small_batches(spark)
    models = []
    for name in (PIECE_MODEL, BYTE_RANKS):  # two files of fixed size
        with open(f"{tokenizers}/{name}", "rb") as f:
            models.append(f.read())
    shared = spark.sparkContext.broadcast(tuple(models))
    kept = docs.select(*carry).schema
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(*shared.value)
        for part, buf, at in S.slices(batches, "_text"):
            found = _measure(buf, at, fertility)
            columns = part.columns[: len(carry)]
            columns += [pa.array(found[k], pa.float64() if k == "token_entropy" else pa.int64(), from_pandas=True) for k in names]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, *names])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), MEASURES])
    return docs.select(*carry, docs["text"].alias("_text")).mapInArrow(run, ddl)


def judge(measured: DataFrame, bands: Bands | None = None) -> DataFrame:
    """Adds base_failed, kept and the first measure that left its band (null if none)."""
    bands = bands or Bands()
    entries = [*bands.by_language.items(), *bands.by_script.items()]
    script = F.when(F.col("n_ascii_letters") * 2 >= F.col("n_letters"), F.lit("latin")).otherwise(F.lit("other"))
    named = F.coalesce(F.when(F.col("lang").isin(*bands.by_language), F.col("lang")), script)

    def limit(name: str) -> F.Column:
        table = F.create_map(*[x for k, band in entries for x in (F.lit(k), F.lit(float(getattr(band, name))))])
        return F.element_at(table, F.col("band"))

    n = F.greatest(F.col("piece_tokens"), F.lit(1)).cast("double")
    below = lambda value, kind: (value < limit(f"{kind}_centre") - MARGIN - limit(f"{kind}_spread") / F.sqrt(n))
    off = lambda test: F.coalesce(test, F.lit(False))
    evenness = F.col("token_entropy") / F.log2(F.greatest(n, F.lit(2.0)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        measured.withColumn("band", named)
        .withColumn("piece_chars", F.col("word_chars") / F.nullif("piece_tokens", F.lit(0)))
        .withColumn("byte_chars", F.col("word_chars") / F.nullif("byte_tokens", F.lit(0)))
        .withColumn("fallback_share", F.col("fallback_tokens") / F.nullif("piece_tokens", F.lit(0)))
        .withColumn("evenness", F.round(evenness, 9))
        .withColumn(
            "off_band",
            F.when(off(below(F.col("piece_chars"), "piece") | (F.col("piece_chars") > MOST_PIECE_CHARS)), F.lit("piece_chars"))
            .when(off(below(F.col("byte_chars"), "byte") | (F.col("byte_chars") > MOST_BYTE_CHARS)), F.lit("byte_chars"))
            .when(off(F.col("fallback_share") > limit("fallback") + 0.5 / F.sqrt(n)), F.lit("fallback_share"))
            .when(off(F.col("token_entropy") < F.least(limit("entropy"), limit("evenness") * F.log2(n))), F.lit("token_entropy"))
            .when(off(F.col("evenness") < limit("evenness")), F.lit("evenness")),
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & F.col("off_band").isNull())
    )


def spread_of(values: np.ndarray, tokens: np.ndarray, held: float = HELD) -> tuple[float, float]:
    """Centre and spread of a band that holds the share `held` of the values."""
    centre = float(np.median(values))
    return centre, float(np.quantile(np.maximum((centre - values - MARGIN) * np.sqrt(tokens), 0), held))


def fit(docs: DataFrame, good: DataFrame, *, fallback: float = 0.05, rows: int = SAMPLE_ROWS, tokenizers: str = TOKENIZERS) -> dict[str, Band]:
    """Bands by language of at most `rows` documents whose ids `good` holds; the choice is by hash, so reruns agree."""
    known = docs.join(good.select("doc_id").distinct(), "doc_id").where("lang IS NOT NULL").dropDuplicates(["doc_id"])
    sample = judge(measure(known, tokenizers=tokenizers)).where("NOT base_failed").orderBy(F.xxhash64("doc_id")).limit(rows)
    found: dict[str, list] = {}
    for r in sample.select("lang", "piece_tokens", "piece_chars", "byte_chars").collect():
        found.setdefault(r.lang, []).append(r[1:])
    out = {}
    for lang, own in sorted(found.items()):
        tokens, piece, byte = np.array(own, float).T
        out[lang] = Band(*spread_of(piece, tokens), *spread_of(byte, tokens), fallback)
    return out


def quality_rules(docs: DataFrame, *, bands: Bands | None = None, tokenizers: str = TOKENIZERS, carry: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    return judge(measure(docs, tokenizers=tokenizers, carry=carry), bands)


def keep_good(docs: DataFrame, *, bands: Bands | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The documents that pass, with all their columns, whatever these are called."""
    carried = [f"_in{i}" for i in range(len(docs.columns))]
    shielded = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, carried, strict=True)], "lang", "text")
    judged = quality_rules(shielded, bands=bands, tokenizers=tokenizers, carry=(*carried, "lang"))
    return judged.where("kept").select(*[F.col(k).alias(c) for c, k in zip(docs.columns, carried, strict=True)])
