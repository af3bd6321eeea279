"""Collocations against plain Python with whole numbers of any length, and against their SQL."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from tessera.llm import collocations as C
from tessera.llm import queries


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(rows, min_count, max_words, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\f\r]", lowered(text or "")):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, max_words + 1) for i in range(len(words) - k + 1))
    found = {g: a for g, a in counts.items() if len(g[1]) > 1 and a >= min_count}
    out = []
    for (lang, words), a in found.items():
        if any(g[0] == lang and len(g[1]) > len(words) and 100 * f >= 50 * a and any(g[1][i : i + len(words)] == words for i in range(len(g[1]))) for g, f in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(ranked)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["Neu", "york", "NEW", "é", "日本", "a", "b", "c'd", "x-y", "1", " ", "rare"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words[:11] if rng.random() < 0.97 else words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None, "und", "x\ny"])))
    return rows


def mined(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, n long, phrase string, id int").repartition(3)
    found = C.collocations(docs, log_bits=16, **settings)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize(("max_words", "chunk_bytes", "top"), [(3, 1000, 2000), (4, 8 << 20, 25), (2, 300, 2000)])
def test_equals_plain_counts(spark, max_words, chunk_bytes, top):
    rows = corpus(150, max_words)
    got = mined(spark, rows, min_count=6, max_words=max_words, chunk_bytes=chunk_bytes, top=top)
    want = expected(rows, 6, max_words, top)
    assert got == want and len(got) > 20


def test_nulls_repeats_long_texts_and_overlaps(spark):
    rows = [(None, "en"), ("", None), (None, None), ("  \t", "en"), ("a a a a a a a a", "en")] * 3 + [("x y z. " * 20_000, "en"), ("w" * 50_000 + " v", "de")] + [("same text here", "de")] * 12 + [("alone", "fr")]
    assert mined(spark, rows, top=50) == expected(rows, 10, 3, 50)


def test_a_full_filter_and_few_rows_per_salt_change_nothing(spark, monkeypatch):
    rows = corpus(80, 9)
    monkeypatch.setattr(C, "SALT_ROWS", 3)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, C.collocations(docs, log_bits=5, min_count=4, top=7).collect())) == expected(rows, 4, 3, 7)


def test_empty_table_and_no_candidates(spark):
    assert mined(spark, [("one two", "en")]) == []
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**12 + 1, 5 * 10**12 + 7, 4 * 10**12 + 9
    level = spark.createDataFrame([(a, [left, a], [right, a])], "f long, pre array<long>, suf array<long>")
    cut = level.select(C._lowest_cut(2).alias("c")).select("c.*").first()
    assert (cut.score, cut.k, cut.l, cut.r) == (10**6 * a * a // (left * right), 1, left, right)


def test_streams_tell_pairs_apart_and_mark_gaps():
    names = np.array([70, 80, 90], np.int64)
    linked, codes, left, right, n = C._stream_columns(np.array([True, False, False, True, False]), np.array([0, 1, 0, 0, 1, 0]), np.array([1, 2, 0, 1, 2, 1]), names)
    assert linked.to_pylist() == [2] and codes.to_pylist() == [[0, 1, -1, 0, 1]]
    assert (left.to_pylist(), right.to_pylist(), n.to_pylist()) == ([[70, 80, 70]], [[80, 90, 70]], [[3, 2, 1]])


def test_words_of_one_name_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(C.S, "span_hashes", lambda buf, starts, ends, block=0: np.zeros(len(starts), np.uint64))
    batch = pa.RecordBatch.from_pydict({"_lang": ["en"], "_text": ["a b"]})
    assert len(np.unique(C._Words(*next(C._chunks(iter([batch]), 10))).names)) == 1
    monkeypatch.undo()
    words = spark.createDataFrame([(1, "en", "a", 30), (1, "en", "b", 2), (2, "en", "c", 1), (2, "en", "d", 1)], "id long, lang string, word string, f long")
    with pytest.raises(ValueError, match="two words have the name 1"):
        C.told_apart(words, C._shared_filter(words.where("f > 9").select("id"), 16))
    C.told_apart(words.where("f < 2"), C._shared_filter(words.where("f > 9").select("id"), 16))


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    ours = queries.QUERIES["op13_collocations"](spark, sf).withColumn("n", F.col("n")).toPandas()
    assert len(ours) and difference(ours, duck(sf).execute(C.ORACLE).df()) == ""
