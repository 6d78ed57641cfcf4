import pytest
from pyspark.sql import functions as F

from listingloom.llm import mixing as m


def levels(sizes):
    """Targets by sharing the excess again and again; sizes in order of sources."""
    weights = {s: m.WEIGHTS[i % 3] for i, s in enumerate(sizes)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in sizes}
        full |= over


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 5, "c": 7, "d": 30}, {"a": 10, "b": 0, "c": 1, "d": 1, "e": 2}, {"a": 7}],
)
def test_targets_match_repeated_sharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in m.targets(table).collect()}
    expected = levels(sizes)
    assert got.keys() == expected.keys()
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in got)


def corpus(spark, words):
    rows = []
    for i in range(600):
        source = None if i % 10 == 9 else "hot" if i % 3 == 0 else f"s{i % 7}"
        rows.append((i, words(1 + i * 7919 % 60, i), source, "x", 1.0, "y"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, pace double, cut string")


def test_taken_words_come_near_their_targets_and_reruns_agree(spark, words):
    table = corpus(spark, words)
    first = sorted(map(tuple, m.mix(table).collect()))
    again = sorted(map(tuple, m.mix(table.repartition(5, "source").orderBy(F.desc("doc_id"))).collect()))
    assert first == again and len(first) == 600
    by = m.mix(table).join(table.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("copies").alias("most"),
        F.max(F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("over"),
    )
    for r in by.collect():
        assert abs(r.taken - r.target) <= 30 and r.most <= 3 and 0 <= r.over <= 1


def test_larger_documents_are_likelier_and_certain_ones_come_first(spark):
    rows = [(i, "w " * (400 if i < 3 else 10), "a") for i in range(200)] + [(900, "w " * 30000, "b")]
    got = {r.doc_id: r.copies for r in m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == max(got[j] for j in range(200)) for i in range(3))


def test_the_mix_holds_each_document_as_often_as_it_is_taken(spark, words):
    table = corpus(spark, words)
    copies = {r.doc_id: r.copies for r in m.mix(table).collect() if r.copies}
    out = m.mixed(table)
    assert out.columns == table.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == copies


def test_odd_rows(spark, odd_docs, no_docs):
    rows = m.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.size for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert len({(r.doc_id, r.size, r.copies) for r in rows if r.doc_id == 4}) == 1  # full ties share their fate
    assert m.mixed(odd_docs).columns == odd_docs.columns
    assert m.mix(no_docs).count() == 0 and m.mixed(no_docs).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in m.mix(empty).collect()] == [(0.0, 0), (0.0, 0)]
