"""Near-duplicates against the links of all pairs; signatures against the method's definition."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from listingloom.llm import components
from listingloom.llm import superminhash as m
from listingloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    k = min(m.SHINGLE, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def brute(rows):
    """doc_id, n_shingles, component_id, kept of rows with different ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(QUERIES["op12_superminhash"](spark, SF)) == brute(docs)


def near(words, rnd, edits):
    out = list(words)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"w{rnd.randrange(99)}"
    return out


def test_large_groups_of_near_copies_and_chains(spark, docs, words, monkeypatch):
    rnd = random.Random(4)
    base, other = words(90, 1).split(), words(120, 2).split()
    texts = [" ".join(near(base, rnd, rnd.randint(0, 3))) for _ in range(90)]
    texts += [" ".join(near(other, rnd, rnd.randint(0, 9))) for _ in range(40)]
    chain = words(100, 3).split()
    for i in range(12):  # each is near the next only
        chain = [*chain[6:], *words(6, 100 + i).split()]
        texts.append(" ".join(chain).upper())
    passage = words(40, 4)  # shared by many that are no copies
    texts += [f"{words(30, 200 + i)} {passage}" for i in range(40)]
    texts += [None, "", " \n", "one two", "One  TWO", "one two three"]
    rnd.shuffle(texts)
    expected = brute(list(enumerate(texts)))
    assert len({c for _, _, c, _ in expected}) > 40 and Counter(c for _, _, c, _ in expected).most_common(1)[0][1] > 60
    assert result(m.near_duplicates(docs(texts))) == expected
    monkeypatch.setattr(components, "TOGETHER", 2)  # every bucket by leaders, in several rounds
    assert result(m.near_duplicates(docs(texts))) == expected


def test_signatures_follow_the_definition(words):
    """Step by step, with a permutation that is shuffled as it is visited."""
    size = 13
    texts = [words(n, n) for n in (1, 3, 5, 9, 40, 200)]
    sets = m.shingle_sets(texts, {})
    got = m.signatures_of(sets, size)
    for row, some in zip(got.tolist(), sets):
        least = [2**64 - 1] * size
        for x in some.tolist():
            order = list(range(size))
            for j in range(size):
                z = int(m.shuffled64(np.array([(x + m._GOLDEN * (j + 1)) % 2**64], np.uint64))[0])
                k = j + ((z >> 32) * (size - j) >> 32)
                order[j], order[k] = order[k], order[j]
                least[order[j]] = min(least[order[j]], (z & 0xFFFFFFFF) | j << 32)
        assert row == least


def test_signatures_estimate_with_less_variance():
    rnd = np.random.default_rng(3)
    errors = []
    for _ in range(200):
        pool = rnd.integers(0, 2**63, 60).astype(np.uint64)
        a, b = m.signatures_of([np.sort(pool[:50]), np.sort(pool[10:])], 64)  # 40 of 60
        errors.append((a == b).mean() - 40 / 60)
    independent = (40 / 60) * (20 / 60) / 64
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.85 * independent


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = m.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by_id[0] == by_id[1] == by_id[2] or by_id[0] == [(0, 0, True)]
    assert by_id[1] == [(0, 1, True)] and by_id[3] == [(1, 3, True)]
    assert all(x[1] == 4 for i in (4, 5) for x in by_id[i]) and len(by_id[4]) == 3
    assert sorted(x[:2] for x in by_id[None]) == [(0, None), (77, 4)] or {x[1] for x in by_id[None]} == {None, 4}
    assert not any(x[2] for x in by_id[None])
    assert m.near_duplicates(no_docs).collect() == []


def test_parities_differ_in_no_more_bits_than_sets_in_hashes():
    draw = np.random.default_rng(5)
    for size in (0, 1, 5, 300, 5000):
        whole = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
        for share in (0.0, 0.1, 0.5, 1.0):
            part = whole[draw.random(len(whole)) >= share]
            a, b = m.parities([whole, part]).view(np.uint64)
            odd = sum(int(x ^ y).bit_count() for x, y in zip(a, b))
            assert odd <= len(whole) - len(part) and (len(whole) - len(part) - odd) % 2 == 0


def test_parities_tell_long_sets_apart():
    """Of 800 hashes each and 70 in a hundred in common: 480 differ by far more than a link at 80 allows."""
    draw = np.random.default_rng(6)
    for _ in range(20):
        pool = draw.integers(0, 1 << 63, 942, dtype=np.uint64)
        a, b = m.parities([np.sort(pool[:800]), np.sort(pool[142:])]).view(np.uint64)
        odd = sum(int(x ^ y).bit_count() for x, y in zip(a, b))
        assert 180 * odd > 20 * 1600


def test_pairs_meet_at_the_first_rare_shingle_they_share(spark):
    """Sizes alone decide on bands; a place in the order of shingles that is too late for a link doesn't count."""
    rows = [(100, 0, 100, 5), (100, 27, 79, 27), (100, -1, 100, -1), (100, -12, 100, -12), (100, -13, 100, -1), (80, -1, 100, -21), (80, -1, 100, -22), (81, -3, 100, -1)]
    frame = spark.createDataFrame(rows, "n int, band int, _n int, _band int")
    got = frame.select(m._compatible(F.col, lambda c: F.col(f"_{c}"), 80).alias("may")).collect()
    assert [r.may for r in got] == [True, False, True, True, False, True, False, False]
