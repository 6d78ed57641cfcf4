from pyspark.sql import functions as F

from listingloom.llm import line_dedup as d


def edited(text, mark):
    """All texts that are one edit away, up to the character that is put in."""
    for i in range(len(text) + 1):
        yield text[:i] + mark + text[i:]
        if i < len(text):
            yield text[:i] + text[i + 1 :]
            yield text[:i] + mark + text[i + 1 :]


def test_lines_have_few_keys(spark):
    """Four for each class of lengths that a line takes part in, not three to five for each length."""
    lines = spark.createDataFrame([("é" * n, n) for n in range(1, 400)], "line string, len int")
    made = {r.len: r["count"] for r in d.keyed(lines).groupBy("len").count().collect()}
    assert {n: made[n] for n in (8, 9, 10, 19, 20, 21, 24, 26, 64, 66, 399)} == {
        8: 2, 9: 2, 10: 4, 19: 2, 20: 6, 21: 4, 24: 8, 26: 4, 64: 8, 66: 4, 399: 4,
    }
    assert min(made) == 8
    assert sum(made.values()) < 5.5 * len(made)


def test_linked_lines_share_a_key_that_one_of_them_owns(spark):
    """All ways to make two edits, in lines without a character twice, across the ends of classes."""
    pairs = []
    for n in (8, 9, 10, 18, 19, 20, 21, 22, 23, 24, 25, 27):
        line = "".join(chr(0x4E00 + i) for i in range(n))
        for near in edited(line, "#"):
            pairs += [(line, near), *((line, two) for two in edited(near, "%"))]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs) if p[0] != p[1]], "pair long, a string, b string")
    rows = rows.where(F.levenshtein("a", "b") <= d.edits_of(F.least(F.length("a"), F.length("b"))))
    both = rows.select("pair", F.posexplode(F.array("a", "b")).alias("side", "line")).withColumn("len", F.length("line"))
    met = d.keyed(both).groupBy("pair", "key").agg(F.countDistinct("side").alias("n"), F.max("own").alias("own"))
    met = met.where("n = 2 and own").select("pair").distinct()
    assert rows.count() > 20_000 and rows.join(met, "pair", "left_anti").count() == 0
