"""Jaccard components, decontamination and substring dedup against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, substring_dedup

from .test_lines_and_mix import lowered


def prose(rng, n, words=60):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def documents(seed=3):
    rng = random.Random(seed)
    rows, bases = [], [prose(rng, 60, 5000) for _ in range(4)]
    for i in range(60):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        rows.append((i * 3, " ".join(words)))
    shared = prose(rng, 40, 5000)
    rows += [(200 + i, " ".join(prose(rng, 5 + i, 5000) + shared + prose(rng, 9, 5000))) for i in range(4)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "Two Words"), (304, "two\nwords"), (305, "a b c d"), (306, "a b c d"), (307, "a b c d"), (308, "a b c d e"), (309, "é ß x y z q"), (310, " ".join(prose(rng, 4000, 50)))]
    rows += [(311, rows[0][1]), (311, rows[0][1]), (177, "another text under an id that is taken already"), (None, rows[5][1]), (None, "only me")]
    return rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", lowered(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected_components(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block, log_bits", [(1 << 17, 18), (200, 10), (60, 18)])
def test_components_equal_brute_force(spark, block, log_bits):
    rows = documents()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, root string").repartition(3)
    got = jaccard_join.similarity_components(docs, block=block, log_bits=log_bits)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == expected_components(rows)
    left = jaccard_join.one_of_each(docs, got)
    assert left.columns == docs.columns
    want = len({c for d, n, c in expected_components(rows) if n}) + sum(n == 0 for _, n, _ in expected_components(rows))
    assert left.count() == want


@pytest.mark.parametrize("block", [1 << 17, 3000])
def test_a_hub_that_is_far_from_its_cluster_loses_no_link(spark, block):
    """Chains and groups around one common passage: most rows of the hub's cluster are not similar to it."""
    rng, rows = random.Random(5), []
    common = prose(rng, 30, 5000)
    for g in range(12):
        own = prose(rng, 25, 5000)
        for k in range(12):
            words = common + own
            words[-1 - k % 3 :] = [f"y{g}{k}"] * (1 + k % 3)
            rows.append((g * 100 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.similarity_components(docs, block=block, log_bits=18)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == expected_components(rows)


def test_one_cluster_of_many_near_copies(spark):
    rng = random.Random(6)
    base = prose(rng, 120, 5000)
    rows = [(i, " ".join([*base[: i % 100], f"z{i}", *base[i % 100 + 1 :]])) for i in range(20_000)] + [(30_000, " ".join(prose(rng, 120, 5000)))]
    got = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {tuple(r) for r in got.groupBy("component_id").count().collect()} == {(0, 20_000), (30_000, 1)}


def test_a_forest_connects_what_is_similar():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < 0.08, rng.integers(0, 1 << 60, 60).astype(np.uint64), base if rng.random() < 0.7 else base[::-1] + np.uint64(i % 4))) for i in range(30)]
        sizes = np.array([len(x) for x in sets])
        lists = jaccard_join._Lists(np.concatenate(sets), sizes)
        rows = jaccard_join.Group(np.arange(30), sizes, np.ones(30, np.int64), lists, lists)
        near = lambda x, y: 100 * len(np.intersect1d(sets[x], sets[y])) >= 75 * len(np.union1d(sets[x], sets[y]))  # noqa: E731, B023
        far = np.array([1 - len(np.intersect1d(s, sets[0])) / len(np.union1d(s, sets[0])) for s in sets])
        todo = rng.random(30) < 0.4
        todo[0] = True
        for subset, distance in ((np.ones(30, bool), None), (todo, None), (todo, far)):
            root = list(range(30))
            find = lambda x: x if root[x] == x else find(root[x])  # noqa: E731, B023
            want = lambda pairs: [root.__setitem__(find(x), find(y)) for x, y in pairs] and [find(x) for x in range(30)]  # noqa: E731, B023
            expected = want([(x, y) for x in range(30) for y in range(x) if (subset[x] or subset[y]) and near(x, y)])
            root[:] = range(30)
            got = want(rows.forest(75, np.arange(30), subset, distance)) or list(range(30))
            same = lambda labels: [[a == b for a in labels] for b in labels]
            assert same(got) == same(expected or list(range(30)))


def test_components_of_chunks_of_edges(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 60)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7)]
    rng.shuffle(edges)
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {x: find(x) for x in root}
    for chunk in (1 << 18, 40):
        got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long"), chunk=chunk).collect()}
        assert got == {x: r for x, r in want.items()}


def test_components_of_nothing(spark):
    assert jaccard_join.similarity_components(spark.createDataFrame([], "doc_id long, text string"), log_bits=12).count() == 0


def expected_hits(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t or ""))
    windows = []
    for i, text in items:
        w = words(text)
        windows += [("" if i is None else str(i), tuple(w[k : k + min(10, len(w))])) for k in range(max(1, len(w) - 9))] if w else []
    out = []
    for d, text in rows:
        w, hit, found = words(text), set(), set()
        for i, window in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    long = [" ".join(prose(rng, n, 3000)) for n in (30, 12, 10)]
    items = [(1, long[0]), (2, long[1]), (12, long[2]), (3, "short one"), (4, "short one"), (5, ""), (6, None), (7, "... ---"), (None, "nameless words here")]
    rows = [(i, " ".join(prose(rng, 20, 3000)) + " " + " ".join(rng.choice(long).split()[rng.randrange(4) :][: rng.choice([8, 9, 10, 11, 20])]) + ", " + " ".join(prose(rng, 5, 3000))) for i in range(25)]
    rows += [(50, None), (51, ""), (52, "A SHORT--ONE short one"), (53, "nameless words here"), (54, " ".join(prose(rng, 3000, 40)) + " " + long[0].upper()), (54, long[1]), (54, long[1]), (None, long[2]), (55, "größe " + long[2])]
    docs = spark.createDataFrame([(*r, 9, 8) for r in rows], "doc_id long, text string, n_words int, items int").repartition(3)
    bench = spark.createDataFrame([(*r, "en") for r in items], "item_id long, text string, lang string")
    got = decontaminate.decontaminate(docs, bench, log_bits=12).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == expected_hits(rows, items)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_decontamination_of_and_by_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(docs, none, log_bits=10).select("n_words", "n_hit", "contaminated").collect()] == [(3, 0, False)]
    assert decontaminate.decontaminate(docs.where("false"), spark.createDataFrame([(1, "a b")], "item_id long, text string"), log_bits=10).count() == 0


def expected_cuts(rows, n):
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t or "")
    seen = {}
    for _, text in rows:
        w = split(text)
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])] = seen.get(tuple(w[k : k + n]), 0) + 1
    out = []
    for d, text in rows:
        w, gone = split(text), set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone |= set(range(k, k + n))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, gram, log_bits", [(35, 12, 18), (6, 2, 18), (5, 5, 10)])
def test_substring_dedup_equals_brute_force(spark, window, gram, log_bits):
    rng = random.Random(8)
    rows = documents(8) + [(400, " ".join(prose(rng, 30, 9000) * 3)), (401, "r " * 200), (402, "Case " * 40), (403, "case " * 40), (404, "x" * 20000 + " y")]
    docs = spark.createDataFrame([(*r, "b", 3) for r in rows], "doc_id long, text string, block string, n_words int").repartition(3)
    done = substring_dedup.dedup_substrings(docs, window=window, gram=gram, log_bits=log_bits)
    got = done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == expected_cuts(rows, window)


def greedy(starts, counts, keys, places, window):
    """The parse by trying, at each position, every reference word by word."""
    at = {}
    for s, n, k, p in zip(starts, counts, keys, places):
        for i in range(n):
            at.setdefault(s + i, set()).add((k, p + i))
    factors, i, top = [], 0, max(at) + 1
    while i < top:
        best = 0
        for k, p in at.get(i, ()):
            n = 1
            while (k, p + n) in at.get(i + n, ()):
                n += 1
            best = max(best, n + window - 1)
        factors += [(i, best)] if best else []
        i += best or 1
    inside = {x for s, n in factors for x in range(s, s + n - window + 1)}
    return factors, sorted(x for x in at if x not in inside)


def test_parses_are_greedy_and_lose_no_window():
    rng = random.Random(11)
    for _ in range(80):
        rows = []
        for _ in range(rng.randrange(1, 12)):
            start, n = rng.randrange(60), rng.randrange(1, 9)
            rows += [(start, n, rng.randrange(3), start + rng.choice([0, 0, 2, 5, 9, 40])) for _ in range(rng.randrange(1, 5))]
        starts, counts, keys, places = map(list, zip(*rows))
        want, across = greedy(starts, counts, keys, places, 6)
        got = substring_dedup.parse(*(np.array(x, np.int64) for x in (starts, counts, keys, places)), 6)
        assert [x[:2] for x in got[: len(want)]] == want
        assert sorted(x[0] for x in got[len(want) :]) == across and all(x[1] == 6 for x in got[len(want) :])


def factors_of(docs):
    """Parsed factors by row key, with the words of the documents, from what matches() gives."""
    words = {r.k: (r.doc_id, re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in docs.select("doc_id", substring_dedup.S.row_key().alias("k"), "text").collect()}
    rows = Counter(r.k for r in docs.select(substring_dedup.S.row_key().alias("k")).collect())
    found = {}
    for r in substring_dedup.matches(docs, log_bits=18).collect():
        own = words[r.row_key][1][r.start : r.start + r.n + 34]
        assert len(own) == r.n + 34
        for ref in r.refs:
            assert words[ref.row_key][1][ref.start : ref.start + r.n + 34] == own
            if rows[r.row_key] > 1 or (ref.row_key, ref.start) != (r.row_key, r.start):
                found.setdefault(r.row_key, set()).add((r.start, r.n, ref.row_key, ref.start))
    return words, rows, {k: substring_dedup.parse(*(np.array(x, np.int64) for x in zip(*sorted(own))), 35) for k, own in found.items()}


def longest_elsewhere(words, rows, key, start):
    """The longest stretch from a place that stands at another place, by trying all places."""
    own, best = words[key][1], 0
    for k, (_, other) in words.items():
        for p in range(len(other) - 34):
            if (k, p) == (key, start) and rows[k] == 1:
                continue
            n = 0
            while start + n < len(own) and p + n < len(other) and own[start + n] == other[p + n]:
                n += 1
            best = max(best, n)
    return best if best >= 35 else 0


def test_factors_are_the_longest_of_all_places(spark):
    rng = random.Random(8)
    passages = [[f"p{k}x{rng.randrange(9)}" for _ in range(rng.choice([36, 50, 90]))] for k in range(5)]
    rows = []
    for i in range(14):
        text = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 14)
            text += p[cut : rng.choice([len(p), len(p), cut + 36])] + [f"own{i}y{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 5))]
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    substring_dedup.PLACES, before = 10**6, substring_dedup.PLACES
    try:
        words, copies, parsed = factors_of(docs)
    finally:
        substring_dedup.PLACES = before
    assert len(parsed) > 5
    for key, (_, own) in words.items():
        i, want = 0, []
        while i + 35 <= len(own):
            if n := longest_elsewhere(words, copies, key, i):
                want.append((i, n))
            i += n or 1
        got = [(s, n) for s, n, k, _ in parsed.get(key, []) if k]
        assert got == want


def test_a_document_between_two_sources_has_two_factors(spark):
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b = text(60), text(50)
    rows = [(1, a + b), (2, text(9) + a + text(4)), (3, b + text(7)), (4, text(80)), (5, a[:30] + text(3) + b[15:]), (6, text(40))]
    rows += [(7, rows[5][1]), (8, text(45)), (8, None)]
    rows[-1] = (8, rows[-2][1])  # twice the same row: each refers to the other
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    words, copies, parsed = factors_of(docs)
    factors = {}
    for key, own in parsed.items():
        for start, length, other, place in own:
            if other:
                assert copies[key] > 1 or (other, place) != (key, start)
                assert words[other][1][place : place + length] == words[key][1][start : start + length]
                assert length == longest_elsewhere(words, copies, key, start)
        factors[words[key][0]] = [(start, length, words[other][0]) for start, length, other, _ in own if other]
    assert factors[1] == [(0, 60, 2), (60, 50, 3)]
    assert factors[2] == [(9, 60, 1)] and factors[3] == [(0, 50, 1)] and 4 not in factors
    assert [x[:2] for x in factors[5]] == [(33, 35)] and factors[6] == [(0, 40, 7)] and factors[7] == [(0, 40, 6)] and factors[8] == [(0, 45, 8)]
    done = {(r.doc_id, r.n_removed, r.n_factors) for r in substring_dedup.dedup_substrings(docs, log_bits=16).collect()}
    assert done == {(1, 110, 2), (2, 60, 1), (3, 50, 1), (4, 0, 0), (5, 35, 1), (6, 40, 1), (7, 40, 1), (8, 45, 1)}


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string"), log_bits=12).count() == 0
