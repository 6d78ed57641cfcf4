import math
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from listingloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def h_text(s):
    return xxhash.xxh64_intdigest(s.encode(), seed=42)


def h_long(v, seed=42):
    return xxhash.xxh64_intdigest(struct.pack("<Q", v), seed=seed)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def grams(text):
    hs = [h_text(w) for w in WORD.findall(text or "")]
    one = [signed(h_long(h)) % q.BUCKETS for h in hs]
    two = [signed(h_long(b, h_long(a))) % q.BUCKETS for a, b in zip(hs, hs[1:])]
    return one + two


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def test_counts_and_ratio_match_brute_force(spark, docs, words):
    texts = [words(60 + i, i) for i in range(30)]
    texts += ["## " + words(70, 50) + "\nx <b>|\nx <b>|", "to be or " * 40, words(55, 3) + " " + words(55, 3), "", None]
    labels = spark.createDataFrame([(i, 1 if i < 12 else 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.verdict for r in q.with_verdict(docs(texts).drop("verdict"), labels).collect()}
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i < 12:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def weight(b):
        expected = max(raw[b] - 1, 0) * n_target / n_raw
        return math.floor(math.log((target[b] + q.SMOOTHING) / (expected + q.SMOOTHING)) * q.UNIT + 0.5)

    for i, t in enumerate(texts):
        v = got[i]
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words) == base(t)
        failed = v.n_words < 50 or 100 * v.n_repeat_words > 50 * v.n_words
        found = grams(t)
        ratio = sum(map(weight, found)) / len(found) / q.UNIT if found else 0.0
        assert abs(v.log_ratio - ratio) < 1e-5
        assert v.base_failed == failed
        assert v.kept == (not failed and v.log_ratio >= q.THRESHOLD)


def test_filtering_agrees_with_the_column(spark, docs, words):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    table = docs([words(60 + i, i) for i in range(8)] + ["%% ** " * 60, "short"]).drop("verdict")
    judged = q.with_verdict(table, labels, "_v")
    assert judged.where("_v.kept").count() == sum(r["_v"].kept for r in judged.collect()) == 8


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = q.with_verdict(odd_docs, none, "_v").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert tuple(r["_v"])[:5] == base(r.text)
        assert r["_v"].log_ratio == 0
    assert q.with_verdict(no_docs, none, "_v").count() == 0
    nulls = spark.createDataFrame([(None, None, None), (4, None, None)], "doc_id long, quality int, toxic int")
    assert q.with_verdict(odd_docs, nulls, "_v").where("_v.kept").count() == sum(r["_v"].kept for r in rows)


def test_trusted_sample_does_not_depend_on_order(spark):
    ids = spark.range(q.TRUSTED_BOUND + 500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    a = q.trusted_ids(ids).agg(F.count("*"), F.sum("doc_id")).first()
    b = q.trusted_ids(ids.repartition(7, "doc_id").orderBy(F.desc("doc_id"))).agg(F.count("*"), F.sum("doc_id")).first()
    assert a == b and a[0] == q.TRUSTED_BOUND
