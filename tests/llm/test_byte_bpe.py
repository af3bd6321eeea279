"""Byte-level BPE against the tokeniser library itself, and back to the same bytes."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import byte_bpe, queries
from tessera.llm import support as S

#: Fixed value: the pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe._rank_file(byte_bpe.TOKENIZERS, byte_bpe.BYTE_RANKS))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.vocabulary(byte_bpe._rank_file(byte_bpe.TOKENIZERS, byte_bpe.BYTE_RANKS)), byte_bpe.code_point_classes())


def texts():
    rng = random.Random(3)
    alphabet = ["'", "'", "s", "t", "re", "ve", "ll", "d", "m", "S", " ", " ", "  ", "\n", "\t", " ", "　", "\x1c", "1", "٣", "Ⅷ", "é", "ß", "中文", "ᲊ", "𐵀", "é", "!", "…", "😀", "\U000e0041", "\0", "<|endoftext|>", "_", "x"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    fixed = ["", " ", "'", "''s", " 's", "\n's", "it's we're I'll'd 'tis 'S", "a  b", "a \n b ", "a\n\n", "   ", " \t", "'l", "'lx", "'r", "'ree", "x'", "0'd", "'s's've"]
    return fixed + out


def pieces_of(encoder, rows):
    buf, at = S.buffer_of(pa.array(rows))
    ids, offsets, bounds = encoder.encode(buf, at)
    return [(ids[a:b].tolist(), offsets[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_ids_and_offsets_equal_the_library(encoder, library):
    rows = texts()
    for text, (ids, offsets) in zip(rows, pieces_of(encoder, rows), strict=True):
        want = library.encode_ordinary(text)
        assert ids == want, text
        sizes = [len(library.decode_single_token_bytes(i)) for i in want]
        assert offsets == np.cumsum([0, *sizes])[: len(sizes)].tolist()


def test_every_code_point_between_letters(encoder, library):
    rows = ["".join(f"a{chr(c)}b {chr(c)}1'{chr(c)}" for c in range(start, min(start + 997, 0x110000)) if not 0xD800 <= c < 0xE000) for start in range(0, 0x110000, 997 * 3)]
    for text, (ids, _) in zip(rows, pieces_of(encoder, rows), strict=True):
        assert ids == library.encode_ordinary(text)


def test_scan_is_the_automaton_step_by_step():
    rng = np.random.default_rng(4)
    machine = byte_bpe.automaton()
    for n in (1, 63, 64, 65, 64 * 64 + 7, 300_000):
        symbol = rng.integers(0, 8, n).astype(np.uint8)
        symbol[rng.random(n) < 0.05] += 8
        symbol[0] = symbol[0] % 8 + 8
        state, want = byte_bpe.FRESH, []
        for s in symbol.tolist():
            state, starts = byte_bpe._step(byte_bpe.FRESH if s >= 8 else state, s % 8)
            want.append(starts or s >= 8)
        assert machine.piece_starts(symbol).tolist() == want


def test_long_pieces_and_full_caches(encoder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_IDS", 50)
    rng = random.Random(1)
    rows = ["a" * 30_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), " " * 5000 + "x", "é" * 4000, "7" * 999] + texts()[:50]
    for text, (ids, _) in zip(rows, pieces_of(encoder, rows), strict=True):
        assert ids == library.encode_ordinary(text)


def test_through_spark_with_nulls_repeats_and_long_texts(spark, library):
    rows = [(i, t) for i, t in enumerate(texts()[:200])] + [(None, "a b"), (500, None), (500, None), (7, "same"), (7, "same"), (900, "Wort für Wort, it's\n" * 60_000)]
    docs = spark.createDataFrame([(*r, "x", [1]) for r in rows], "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    found = byte_bpe.decode(byte_bpe.encode(docs, carry=("doc_id",))).collect()
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in found), key=repr) == want
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([60_000], [0])], "ids array<int>, offsets array<int>")).collect()


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    found = queries.QUERIES["op12_byte_bpe"](spark, sf)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(want)
