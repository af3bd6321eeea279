"""Phrase collocation mining by hierarchical pair naming.

A phrase of k words is a pair: the phrase of its first k-1 words and that of its
last k-1. Level by level, neighbouring frequent names of k-1 words in the texts are
replaced by the name of their pair, which is given once for the whole corpus and
joined back to the texts; only frequent pairs get one. A name's two parents are
thus pointers to what a cut leaves on either side and to what a longer phrase
subsumes.

1. Words are counted by language; a word is named by a 64-bit hash of language and
   word (two words of one name are an error, which is looked for in all words).
2. Pairs of frequent neighbours are counted by a hash first, and so are two such
   pairs in a row; Bloom filters of the hashes that are frequent leave few. Chunks
   of texts keep a local code for each place where pairs in a row may be frequent,
   and list their pairs with their counts: a stream.
3. A stream's pairs are summed up over all chunks, the frequent ones get their name,
   and the names meet the chunks by (left, right); neighbouring names of a chunk are
   the next level's stream.
4. Every phrase takes the counts of all its beginnings from its left parent and of
   all its ends from its right parent; scores are exact decimals.

Counts are added up within a chunk, then within a task, then by key. Filters have a
fixed number of bits; beyond their capacity more pairs are shuffled and results stay
exact.

Defined cases: a null text has no words, a null language is `und`; rows count one
by one, so repeated rows count again; an empty table gives no rows; other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from . import support as S

MIN_COUNT, MAX_WORDS, TOP, SUBSUMED_PERCENT = 10, 3, 2000, 50
#: Bytes of text that are counted together before anything leaves a task.
CHUNK_BYTES = 4 << 20
#: Candidates of one salt when the best of a language are looked for.
SALT_ROWS = 200_000
_BREAKS = [*b".,;:!?", *range(0x0A, 0x0E)]
_IS_BREAK = ~S.byte_table(*_BREAKS)
_IS_WORD = S.byte_table(0x20, 0x09, *_BREAKS)
#: Bits of the hash that pairs are counted by at first; beyond some 2**HASH_BITS different pairs the count rules few of them out.
HASH_BITS = 40
#: Codes and pairs of a row of a stream: Parquet looks at what it holds every hundred rows and is read 4,096 rows at a time, so a row is small.
PIECE = 256
#: Bits of a chunk's number; those above hold a row's place among the rows of its chunk.
CHUNK_BITS = 40
_STREAM = "chunk long, linked int, codes array<int>, left array<long>, right array<long>, n array<long>"


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Bytes, row bounds and languages of about `limit` bytes of text, or of one longer row."""
    held, size, langs = [], 0, []

    def out() -> tuple[np.ndarray, np.ndarray, list[str]]:
        bounds, base = [np.zeros(1, np.int64)], 0
        for buf, at in held:
            bounds.append(at[1:] + base)
            base += len(buf)
        return np.concatenate([b for b, _ in held]), np.concatenate(bounds), langs

    for part, buf, at in S.slices(batches, "_text"):
        if held and size + len(buf) > limit:
            yield out()
            held, size, langs = [], 0, []
        held.append((buf.copy(), at))
        size += len(buf)
        langs.extend(part.column(0).to_pylist())
    if held:
        yield out()
    S.trim()


class _Words:
    """The words of a chunk: names, bounds in the lower-cased bytes, and which are followed by one of the same piece."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, langs: list[str]):
        self.low = S.lower_ascii(buf)
        self.starts, self.ends, bounds = S.word_bounds(self.low, at, _IS_WORD)
        self.rows = S.row_of(bounds)
        salts = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        salt = np.array([salts[x] for x in langs], np.uint64)
        self.names = S.mix64(S.span_hashes(self.low, self.starts, self.ends) ^ salt[self.rows])
        piece = np.searchsorted(np.flatnonzero(_IS_BREAK[self.low]), self.starts)
        self.followed = (piece[1:] == piece[:-1]) & (self.rows[1:] == self.rows[:-1])


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return S.mix64(left * np.uint64(0x9E3779B97F4A7C15) + right) >> np.uint64(64 - HASH_BITS)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("_lang"), F.col("text").alias("_text"))


def count_words(docs: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, lang, word, f) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, at, langs in _chunks(batches, chunk_bytes):
            words = _Words(buf, at, langs)
            names, first, counts = np.unique(words.names, return_index=True, return_counts=True)
            rows = words.rows[first]
            # language and word in one text, parted by a line feed, which neither a word nor a short column needs more
            heads = [f"{x}\n".encode() for x in langs]
            lead = np.fromiter((len(heads[r]) for r in rows.tolist()), np.int64, len(rows))
            start, size = words.starts[first], words.ends[first] - words.starts[first]
            bounds = np.concatenate([[0], np.cumsum(lead + size)])
            text = np.empty(bounds[-1], np.uint8)
            text[S.ranges(bounds[:-1], lead)] = np.frombuffer(b"".join([heads[r] for r in rows.tolist()]), np.uint8)
            text[S.ranges(bounds[:-1] + lead, size)] = words.low[S.ranges(start, size)]
            spelt = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text))
            yield pa.RecordBatch.from_arrays([_longs(names), spelt, _longs(counts)], names=["id", "spelt", "n"])

    counted = _source(docs).mapInArrow(run, "id long, spelt string, n long").groupBy("id", "spelt").agg(F.sum("n").alias("f"))
    # a word has no line feed, so the last one parts them whatever the language is called
    return S.staged(counted.select("id", F.regexp_extract("spelt", r"(?s)^(.*)\n", 1).alias("lang"), F.substring_index("spelt", "\n", -1).alias("word"), "f"), "words")


def told_apart(words: DataFrame, frequent) -> None:
    """Raise an error if two words have one id that the filter of frequent ids lets through; others are never part of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(ids[frequent.value.test(ids.view(np.uint64))])], names=["id"])

    if clash := words.select("id").mapInArrow(run, "id long").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first():
        raise ValueError(f"two words have the name {clash.id}")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.array(batch.column(0)).view(np.uint64)


def _shared_filter(ids: DataFrame, log_bits: int):
    return ids.sparkSession.sparkContext.broadcast(bloom.build(ids, _ids, "once", log_bits))


def _pairs(words: _Words, frequent: bloom.Bloom) -> np.ndarray:
    """Places of the words that start a pair of frequent neighbours."""
    distinct, back = np.unique(words.names, return_inverse=True)
    good = frequent.test(distinct)[back]
    return np.flatnonzero(words.followed & good[1:] & good[:-1])


def _counted(hashes: np.ndarray) -> pa.RecordBatch:
    distinct, counts = np.unique(hashes, return_counts=True)
    return pa.RecordBatch.from_arrays([_longs(distinct), _longs(counts)], names=["hash", "n"])


def pair_hashes(docs: DataFrame, frequent, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(hash, n): how often pairs of frequent words stand in the corpus, by the pair's hash; pairs that share one are summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, at, langs in _chunks(batches, chunk_bytes):
            words = _Words(buf, at, langs)
            i = _pairs(words, frequent.value)
            yield _counted(_pair_hash(words.names[i], words.names[i + 1]))

    return _source(docs).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _likely_pairs(words: _Words, frequent: bloom.Bloom, likely: bloom.Bloom) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that pass both filters, and their hashes."""
    i = _pairs(words, frequent)
    hashes = _pair_hash(words.names[i], words.names[i + 1])
    good = likely.test(hashes)
    return i[good], hashes[good]


def chain_hashes(docs: DataFrame, frequent, likely, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(hash, n) of two likely pairs in a row, as pair_hashes()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, at, langs in _chunks(batches, chunk_bytes):
            i, hashes = _likely_pairs(_Words(buf, at, langs), frequent.value, likely.value)
            yield _counted(_pair_hash(hashes[:-1], hashes[1:])[i[1:] == i[:-1] + 1])

    return _source(docs).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _stream_columns(goes_on: np.ndarray, left: np.ndarray, right: np.ndarray, names: np.ndarray) -> list[pa.Array]:
    """linked, codes, left, right, n of a chunk: the pairs (names[left], names[right]) at its places.

    `left` and `right` are codes, so that pairs are told apart exactly; goes_on says
    which pairs are in a row with the next one. A code of -1 parts those that are
    not; lone ones are left out. The first `linked` pairs are those with a code
    among them.
    """
    distinct, code, counts = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True, return_counts=True)
    near = np.append(goes_on, False) | np.append(False, goes_on) if len(left) else np.zeros(0, bool)
    alone = np.ones(len(distinct), bool)
    alone[code[near]] = False
    order = np.argsort(alone, kind="stable")
    distinct, counts, moved = distinct[order], counts[order], np.empty(len(order), np.int64)
    moved[order] = np.arange(len(order))
    places = np.flatnonzero(near)
    codes = np.insert(moved[code[places]], np.flatnonzero(~goes_on[places[:-1]]) + 1, -1)
    columns = [pa.array(codes.astype(np.int32)), _longs(names[distinct >> 32]), _longs(names[distinct & 0xFFFFFFFF]), _longs(counts)]
    return [pa.array([int((~alone).sum())], pa.int32()), *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]]


def _pieces(chunk: int, linked: pa.Array, *lists: pa.Array) -> pa.RecordBatch:
    """A chunk's rows of a stream: PIECE codes and pairs each, of which the first `linked` pairs have a code among the chunk's."""
    values = [x.flatten() for x in lists]
    starts = np.arange(-(-max(map(len, values)) // PIECE) + 1) * PIECE
    lists = [pa.ListArray.from_arrays(pa.array(np.minimum(starts, len(v)), pa.int32()), v) for v in values]
    own = np.clip(linked[0].as_py() - starts[:-1], 0, PIECE)
    return pa.RecordBatch.from_arrays([pa.array(chunk | starts[:-1] // PIECE << CHUNK_BITS, pa.int64()), pa.array(own, pa.int32()), *lists], names=_FIELDS)


_FIELDS = ["chunk", "linked", "codes", "left", "right", "n"]
_NO_STREAM = pa.schema(list(zip(_FIELDS, [pa.int64(), pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3], strict=True))).empty_table()


def text_stream(docs: DataFrame, frequent, likely, chains=None, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The stream of word pairs that pass the filters; without one for chains no pairs are in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << CHUNK_BITS // 2
        for k, (buf, at, langs) in enumerate(_chunks(batches, chunk_bytes)):
            words = _Words(buf, at, langs)
            i, hashes = _likely_pairs(words, frequent.value, likely.value)
            goes_on = i[1:] == i[:-1] + 1
            goes_on &= chains.value.test(_pair_hash(hashes[:-1], hashes[1:])) if chains is not None else False
            names, code = np.unique(words.names, return_inverse=True)
            yield _pieces(first + k, *_stream_columns(goes_on, code[i], code[i + 1], names))

    return _source(docs).mapInArrow(run, _STREAM)


def name_pairs(stream: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(id, left, right, f): the frequent pairs of a stream, each under one name for the whole corpus."""
    rows = stream.select(F.explode(F.arrays_zip("left", "right", "n")).alias("p")).select("p.*")
    sums = rows.groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    return S.staged(sums.withColumn("id", F.monotonically_increasing_id()).select("id", "left", "right", "f"), "pairs")


def next_stream(stream: DataFrame, pairs: DataFrame) -> DataFrame:
    """The places of a stream under the names of their pairs; neighbouring names are its pairs."""
    of = F.col("chunk").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).alias("of")
    linked = [F.slice(c, 1, F.col("linked")).alias(c) for c in ("left", "right")]
    local = stream.where("linked > 0").select(of, (F.shiftright("chunk", CHUNK_BITS) * PIECE).alias("at"), F.posexplode(F.arrays_zip(*linked))).select("of", (F.col("at") + F.col("pos")).alias("code"), "col.left", "col.right")
    # chunk by chunk in order of the key: lists of all a task's chunks at a time would grow with the input
    known = local.join(pairs.select("left", "right", "id"), ["left", "right"]).select("of", "code", "id")

    def run(own: pa.Table, named: pa.Table) -> pa.Table:
        if not own.num_rows or not named.num_rows:
            return _NO_STREAM
        own = own.sort_by("chunk")
        codes = np.array(own["codes"].combine_chunks().flatten(), np.int64)
        code, names = np.array(named["code"], np.int64), np.array(named["id"], np.int64)
        place_of = np.full(int(codes.max()) + 1, -1, np.int64)
        place_of[code] = np.arange(len(code))
        at = np.where(codes >= 0, place_of[codes], -1)
        i = np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0))
        return pa.Table.from_batches([_pieces(own["of"][0].as_py(), *_stream_columns(i[1:] == i[:-1] + 1, at[i], at[i + 1], names))])

    return stream.where("size(codes) > 0").select(of, "chunk", "codes").groupBy("of").cogroup(known.groupBy("of")).applyInArrow(run, _STREAM)


def phrases(docs: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, log_bits: int = bloom.LOG_BITS, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language (lang, n), and by number of words the frequent phrases.

    Those have id, lang, phrase, last (word), f, and the counts of their
    beginnings (pre) and ends (suf) by length; longer ones also left and right.
    """
    S.small_batches(docs.sparkSession)
    words = count_words(docs, chunk_bytes=chunk_bytes)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    common = words.where(F.col("f") >= min_count)
    levels = [common.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("pre"), F.array("f").alias("suf"))]
    if max_words < 2:
        return totals, levels
    frequent = _shared_filter(common.select("id"), log_bits)
    told_apart(words, frequent)
    hashes = S.staged(pair_hashes(docs, frequent, chunk_bytes=chunk_bytes).where(F.col("n") >= min_count).select("hash"), "pair-hashes")
    likely = _shared_filter(hashes, log_bits)
    shared = [frequent, likely]
    if max_words > 2:
        rows = S.staged(chain_hashes(docs, frequent, likely, chunk_bytes=chunk_bytes).where(F.col("n") >= min_count).select("hash"), "chain-hashes")
        shared.append(_shared_filter(rows, log_bits))
        S.discard(rows)
    stream = S.staged(text_stream(docs, *shared, chunk_bytes=chunk_bytes), "pair-stream")
    S.release(*shared)
    S.discard(hashes)
    for k in range(2, max_words + 1):
        pairs = name_pairs(stream, min_count)
        left = levels[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), "pre")
        right = levels[-1].select(F.col("id").alias("right"), "last", "suf")
        longer = pairs.join(left, "left").join(right, "right")
        longer = longer.select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", F.array_append("pre", F.col("f")).alias("pre"), F.array_append("suf", F.col("f")).alias("suf"), "left", "right")
        levels.append(S.staged(longer, "phrases"))
        if k < max_words:
            following = S.staged(next_stream(stream, pairs), "pair-stream")
            S.discard(stream)
            stream = following
    S.discard(stream)
    return totals, levels


def _lowest_cut(words: int):
    """Struct (score, k, l, r) of the cut with the lowest score, ties to the smallest k; exact in 38 digits."""
    whole = lambda c: c.cast("decimal(20,0)")
    cuts = []
    for k in range(1, words):
        left, right = F.element_at("pre", k), F.element_at("suf", words - k)
        top, below = F.lit(1_000_000).cast("decimal(7,0)") * whole(F.col("f")) * whole(F.col("f")), whole(left) * whole(right)
        cuts.append(F.struct(F.call_function("div", top, below).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, log_bits: int = bloom.LOG_BITS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to max_words words."""
    totals, levels = phrases(docs, min_count=min_count, max_words=max_words, log_bits=log_bits, chunk_bytes=chunk_bytes)
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    found = None
    for words, level in enumerate(levels[1:], 2):
        scored = level.withColumn("cut", _lowest_cut(words)).select("id", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        if words < max_words:
            # a phrase's longest counts are those of the phrases that have it as a parent
            longer = levels[words]
            parents = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("most"))
            scored = scored.join(parents, "id", "left").where(F.coalesce(100 * F.col("most") < SUBSUMED_PERCENT * F.col("a"), F.lit(True)))
        scored = scored.select(*columns)
        found = scored if found is None else found.unionByName(scored)
    held = S.staged(found, "collocations")
    salts = -(-held.count() // SALT_ROWS) or 1
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of a language are among the best of each of its salts
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    best = held.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT doc, lang, p, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS "at" FROM (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, 0 AS p,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
    FROM documents)),
words AS (
  SELECT doc, "at", lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc, "at", lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY doc, "at" ORDER BY i)),
totals AS (SELECT lang, count(*)::BIGINT AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w1, count(*)::BIGINT AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*)::BIGINT AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*)::BIGINT AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
two AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, 1000000::HUGEINT * p.f * p.f // (x.f::HUGEINT * y.f) AS score
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  LEFT JOIN longer m ON m.lang = p.lang AND m.w1 = p.w1 AND m.w2 = p.w2 WHERE m.most IS NULL OR 100 * m.most < 50 * p.f),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
         1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * yz.f) AS s1, 1000000::HUGEINT * t.f * t.f // (xy.f::HUGEINT * z.f) AS s2
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f1 z ON z.lang = t.lang AND z.w1 = t.w3
  JOIN f2 xy ON xy.lang = t.lang AND xy.w1 = t.w1 AND xy.w2 = t.w2 JOIN f2 yz ON yz.lang = t.lang AND yz.w1 = t.w2 AND yz.w2 = t.w3),
found AS (
  SELECT * FROM two UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
