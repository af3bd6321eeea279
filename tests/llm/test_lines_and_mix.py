"""Line dedup and source mixing against plain Python, with null, empty, long, tied and repeated rows."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, queries

SPACES = " \t\n\x0b\f\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def key(line):
    return lowered(line.strip(SPACES))


def documents():
    rng = random.Random(5)
    lines = [f"{'Gemeinsame Zeile' if i % 2 else 'Common line ÀÉ'} number {i} that is long enough to count as one" for i in range(12)] + ["short", "", "  ", "x" * 39, "y" * 40]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.8 else f"own {i} {k} " * 4 for k in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "  " + lines[1].upper() + "\t\n" + lines[1]), (104, (lines[2] + "\n") * 3000), (105, "y" * 40), (None, lines[3]), (106, "nul\x00\n" + lines[4])]
    return rows


def expected_lines(rows, least_docs=5):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    bad = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(ds) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) in bad and bad[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "k", 1, "x") for r in rows], "doc_id long, text string, key string, n_lines int, keeper string").repartition(3)
    done = line_dedup.dedup_lines(docs, log_bits=16)
    assert set(done.columns) == {"doc_id", "text", "key", "keeper", "n_lines", "n_dropped"}
    got = done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert sorted(map(tuple, got), key=repr) == expected_lines(rows)


def test_line_dedup_full_filter_still_exact(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, log_bits=10).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert sorted(map(tuple, got), key=repr) == expected_lines(rows)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), log_bits=12).count() == 0


def targets(sizes, most=3):
    """Water filling with exact fractions; sizes in code point order of the sources."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    total, stopped = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in stopped]
        rest, w = total - sum(stopped.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > most * sizes[s]]
        if not over:
            return {**stopped, **{s: rest * weight[s] / w for s in free}}
        stopped |= {s: Fraction(most * sizes[s]) for s in over}


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))), rng.choice(["hot", "hot", "hot", "b", "Z", "é", None])) for i in range(300)]
    return rows + [(1000, None, "hot"), (1001, "", "tiny"), (1002, "one", "small"), (1003, "two still one", "small"), (7, "same id", "hot"), (None, "no id", "b"), (None, "no id", "b"), (1004, "x " * 5000, "long")]


def test_mix_meets_its_targets(spark, mixed_rows):
    docs = spark.createDataFrame([(*r, 5, "k", 0.5) for r in mixed_rows], "doc_id long, text string, source string, size int, key string, target double")
    out = mixing.mix_sources(docs.repartition(4), range_digits=2).collect()
    assert len(out) == len(mixed_rows)
    sizes = {}
    for _, text, source in mixed_rows:
        sizes[source] = sizes.get(source, 0) + len([w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w])
    ordered = {s: sizes[s] for s in [*sorted(s for s in sizes if s is not None), None]}
    want, taken = targets(ordered), defaultdict(int)
    for r in out:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
    for s, n in taken.items():
        assert want[s] - 1 < n <= want[s]


def test_mix_reruns_agree(spark, mixed_rows):
    docs = spark.createDataFrame(mixed_rows, "doc_id long, text string, source string")
    runs = [sorted(((r.doc_id, r.size, r.taken) for r in mixing.mix_sources(docs.repartition(n)).collect()), key=repr) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_mixed_texts_have_the_words_taken(spark, mixed_rows):
    docs = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(mixed_rows)], "doc_id long, text string, source string, size int, taken string")
    plan = mixing.mix_sources(docs)
    made = mixing.materialise(docs, plan)
    assert made.columns == docs.columns
    per_id = lambda df, n: {r[0]: r[1] for r in df.groupBy("doc_id").agg(F.sum(n)).collect() if r[1]}
    assert per_id(made, F.regexp_count("text", F.lit(mixing.WORD))) == per_id(plan, "taken")  # of null and repeated ids too
    texts = {(r[0], i): r[1] for i, r in enumerate(mixed_rows)}
    got = made.collect()
    assert all(texts[r.doc_id, r["size"]].split()[: len(r.text.split())] == r.text.split() and r.taken == "k" for r in got)
    assert len({(r.doc_id, r["size"]) for r in got}) == plan.where("taken > 0").count()


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_every_dealt_operator_has_one_query():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 14))
