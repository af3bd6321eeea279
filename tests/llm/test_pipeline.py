"""The pipeline's stages on a small folder, each against what plain Python makes of its input."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import line_dedup, quality, support

from .test_lines_and_mix import targets
from .test_similarity import expected_components, expected_hits
from .test_texts import PROSE, counts

SHARED = "This line stands in many of the documents and is long enough to be counted."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(12), tmp_path_factory.mktemp("sf")
    words = sorted({w.strip(".,?") for w in PROSE.split()} | set("bridge market winter garden letter mountain summer station council built crossed followed repaired carried remembered painted".split()))
    sentence = lambda: " ".join(rng.choice(words) for _ in range(10)).capitalize() + "."
    text = lambda: " ".join(sentence() for _ in range(14))
    item = "what was the seventh name of the lighthouse keeper who lived beyond the eastern cape"
    rows = [(i, text(), "en", rng.choice(["web", "web", "book"])) for i in range(12)]
    rows += [(20 + i, f"{text()}\n{SHARED}\n{text()}", "en", "web") for i in range(6)]
    copy = text()
    rows += [(40, copy, "en", "web"), (41, copy, "en", "book"), (42, copy + " Ends here.", "en", None), (42, copy + " Ends here.", "en", None)]
    rows += [(50, f"{text()} {item}, {text()}", "en", "web"), (60, "short", "en", "web"), (61, None, None, None), (62, sentence() * 30, "en", "web")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), f"e{i}", 7) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, size int")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plainly_good(text, lang, fertility):
    """The quality verdict of one text, from the vocabularies' own libraries and the bands' numbers."""
    words = plain_words(text)
    n_repeat = counts(text)[4]
    if len(words) < 10 or 100 * n_repeat > 20 * len(words):
        return False
    bands = quality.Bands()
    letters = [c for c in text if c.isalpha()]
    script = "latin" if sum(c.isascii() for c in letters) * 2 >= len(letters) else "other"
    band = bands.by_language.get(lang) or bands.by_script[script]
    pieces = Counter(t for w in words for t in fertility.piece_bpe.encode(w))
    n, chars = sum(pieces.values()), sum(map(len, words))
    n_bytes = sum(len(fertility.byte_bpe.encode_ordinary(" " + w)) for w in words)
    entropy = -sum(k / n * math.log2(k / n) for k in pieces.values())
    fallback = sum(k for t, k in pieces.items() if fertility.piece_bpe.is_byte(t)) / n
    wide = lambda spread: quality.MARGIN + spread / math.sqrt(n)
    return (
        band.piece_centre - wide(band.piece_spread) <= chars / n <= quality.MOST_PIECE_CHARS
        and band.byte_centre - wide(band.byte_spread) <= chars / n_bytes <= quality.MOST_BYTE_CHARS
        and fallback <= band.fallback + 0.5 / math.sqrt(n)
        and entropy >= min(band.entropy, band.evenness * math.log2(n))
        and entropy / math.log2(max(n, 2)) >= band.evenness
    )


def plain_mix(rows):
    """(doc_id, taken) of (doc_id, text, source): every source's rows in the order of their keys, cut at its budget."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(plain_words(text))
    sizes = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}
    wanted = targets(sizes)
    out = []
    for source, size in sizes.items():
        budget = int(wanted[source])
        own = sorted((hashlib.md5(f"mix-1:{'' if d is None else d}".encode()).hexdigest(), len(plain_words(t)), d) for d, t, s in rows if s == source)
        epochs, rest = divmod(budget, size) if size else (0, 0)
        for _, n, d in own:
            part = min(n, rest)
            rest -= part
            out.append((d, epochs * n + part))
    return out


def test_each_stage_decides_as_its_operator_says(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = support.staged(stage(spark, docs, folder), "t")
        ids = sorted(r.doc_id for r in after.select("doc_id").collect())
        if name == "quality_rules":
            fertility = quality.Fertility(*(open(f"{quality.TOKENIZERS}/{n}", "rb").read() for n in (quality.PIECE_MODEL, quality.BYTE_RANKS)))
            assert ids == sorted(r.doc_id for r in docs.collect() if plainly_good(r.text, r.lang, fertility))
            assert not {60, 61, 62} & set(ids) and set(range(12)) <= set(ids)
        elif name == "line_dedup":
            assert ids == sorted(d for d, _ in before)
            assert [r.doc_id for r in after.where(F.contains("text", F.lit(SHARED))).collect()] == [25]
            assert after.where("n_chars <> length(text)").count() == 0
            assert line_dedup.dedup_lines(after).where("n_dropped > 0").count() == 0
        elif name == "ngram_jaccard_join":
            assert ids == sorted({c for _, _, c in expected_components(before)})
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert ids == [d for d, _, hit, _ in sorted(expected_hits(before, items)) if not hit] and 50 not in ids
        else:
            rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
            assert sorted((r.doc_id, r.taken) for r in after.collect()) == sorted(x for x in plain_mix(rows) if x[1])
        if name != "source_mixing":
            assert after.columns == columns
            docs = after
    final = sorted(tuple(r) for r in after.select("doc_id", "taken").collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "taken").collect()) == final


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
