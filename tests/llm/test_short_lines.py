"""Lines too short for any edit: equal ones are found, listed and removed."""

import re

import corpus_pipeline
from listingloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def test_the_query_lists_every_line_with_a_word_and_removes_equal_ones(spark):
    seen, repeats, listed = set(), set(), set()
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        for j, x in enumerate((r.text or "").split("\n")):
            if WORD.search(x):
                listed.add((r.doc_id, j))
                if x in seen:
                    repeats.add((r.doc_id, j))
                seen.add(x)
    got = QUERIES["op7_line_dedup"](spark, SF).collect()
    assert listed == {(r.doc_id, r.line_no) for r in got} and len(got) == len(listed)
    assert repeats <= {(r.doc_id, r.line_no) for r in got if r.removed}


def test_the_stage_removes_short_repeats(spark, docs, words):
    a, b = words(8, 1), words(8, 2)
    out = corpus_pipeline.lines(spark, docs([f"{a}\nhi\n\n{b}", f"{a}!\nhi\n\nho"]), SF).orderBy("doc_id").collect()
    assert [r.text for r in out] == [f"{a}\nhi\n\n{b}", "\nho"]
    assert [r.n_chars for r in out] == [len(r.text) for r in out]
