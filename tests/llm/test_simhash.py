import random

import pytest
import xxhash
from pyspark.sql import functions as F

from listingloom.llm import simhash as s
from listingloom.llm.components import components


def brute_fp(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in text.split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps):
    """Root index of each fingerprint by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_match_brute_force(words):
    for text in ["", "One", "ONE two", "Éa B c", *(words(n, n) for n in (3, 4, 50, 9000))]:
        assert s.fingerprint(text) & (1 << 64) - 1 == brute_fp(text)
    assert s.fingerprint(None) == 0


def cluster(rnd, n, centre, most):
    return [centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("paired", [64, 3])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, paired):
    """With few pairs allowed, the refinement of large variant groups must find the same groups."""
    monkeypatch.setattr(s, "PAIRED", paired)
    rnd = random.Random(paired)
    fps = list(dict.fromkeys([0, *(x for c in range(6) for x in cluster(rnd, 25, rnd.getrandbits(64), 4)), *(rnd.getrandbits(64) for _ in range(60))]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = s.links(table)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    assert edges.where(near > 2).count() == 0
    root = {r.node: r.root for r in components(edges).collect()}
    expected = brute_groups(fps)
    got = [root.get(f, f) for f in signed]
    assert len({*zip(got, expected)}) == len(set(got)) == len(set(expected))


def test_groups_of_odd_rows(spark, odd_docs, no_docs):
    rows = s.simhash_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by[i].fp for i in (0, 1, 2)} == {0} and {by[i].component_id for i in (0, 1, 2)} == {0}
    assert by[4].component_id == by[5].component_id == 4
    assert s.simhash_groups(no_docs).count() == 0


def test_one_row_of_each_group_stays(spark, odd_docs, no_docs):
    kept = s.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [0, 3, 4, 6, 7, 8, 9]
    assert s.one_of_each_group(no_docs).count() == 0


def test_null_ids_do_not_name_groups(spark):
    table = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in s.simhash_groups(table).collect()] == [None, None]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}
