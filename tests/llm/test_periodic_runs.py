"""Periodic runs against trying every period at every word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from listingloom.llm import periodic_runs as p
from listingloom.llm.queries import QUERIES, with_planted_period

SF = "/root/testdata/sf0.001"


def brute(words, least=24, periods=3):
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, periods * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def strip(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("least, periods", [(24, 3), (6, 2), (1, 2), (30, 5)])
def test_runs_match_brute_force(least, periods):
    rnd = random.Random(least)
    for _ in range(250):
        docs = []
        for _ in range(rnd.randint(0, 4)):
            size, doc = rnd.choice([1, 2, 3, 5, 50]), []
            for _ in range(rnd.randint(0, 6)):
                unit = [rnd.randrange(size) for _ in range(rnd.randint(1, 14))]
                doc += (unit * rnd.randint(1, 12))[: rnd.randint(1, 90)]
            docs.append(doc)
        found = p.find_runs([np.array(d, np.int64) for d in docs], least, periods)
        assert found == [brute(d, least, periods) for d in docs]


def test_one_word_throughout_is_one_run():
    assert p.find_runs([np.zeros(30_000, np.int64), np.zeros(23, np.int64)]) == [[(0, 30_000, 1)], []]


def test_the_suffix_array_is_in_order():
    rnd = random.Random(2)
    seq = [*(rnd.randrange(3) for _ in range(300)), 9]
    order, place, shared = p.suffix_array(np.array(seq))
    assert order.tolist() == sorted(range(301), key=lambda i: seq[i:])
    assert [place[i] for i in order] == list(range(301))
    for a, b, n in zip(order[:-1], order[1:], shared[1:]):
        assert seq[a : a + n] == seq[b : b + n] and seq[a + n] != seq[b + n]


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    n_found = 0
    for r in rows:
        words = (texts[r.doc_id] or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
        words = [w.decode() for w in words]
        runs = brute(words)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(strip(words, runs).encode()).hexdigest()
        n_found += bool(runs)
    assert n_found >= 10


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = p.periodic_runs(odd_docs, ["doc_id", "bits"]).collect()
    assert len(rows) == odd_docs.count()
    for r, own in zip(sorted(rows, key=str), sorted(odd_docs.collect(), key=str)):
        assert r.collapsed is not None and r.n_words >= 0
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    expected = sorted((str(i), len((t or "").split()), strip((t or "").split(), brute((t or "").split()))) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_words, r.collapsed) for r in rows) == expected
    assert p.periodic_runs(no_docs, ["doc_id"]).collect() == []
    assert with_planted_period([b"a"], None) == [b"a"]


def test_strongest_prefers_the_exact_ratio_then_the_first(spark):
    from pyspark.sql import functions as F

    runs = spark.createDataFrame(
        [([(9, 30, 7), (2, 60, 14), (5, 61, 14)],), ([(4, 30, 5), (4, 24, 4), (1, 12, 2)],), ([],), (None,)], f"runs {p.RUNS}"
    )
    got = [r.best and tuple(r.best) for r in runs.select(p.strongest(F.col("runs")).alias("best")).collect()]
    assert got == [(5, 61, 14), (1, 12, 2), None, None]
