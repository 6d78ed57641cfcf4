"""The registered queries and the stages of the pipeline over the smallest tables."""

import hashlib
import math
from collections import Counter

import duckdb
import pytest
from test_line_dedup import WORD, allowed, edits
from test_quality_rules import base, grams
from test_sentencepiece import library
from test_simhash import brute_fp, brute_groups

import __spark_entry__ as entry
import corpus_pipeline
from listingloom.llm import quality_rules
from listingloom.llm.oracles import MIXING
from listingloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op4_warc": {"page_id", "record_id", "refers_to", "target_uri", "block_digest"},
    "op5_fingerprints": {
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    },
    "op6_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op7_line_dedup": {"doc_id", "line_no", "class_doc", "class_line", "removed"},
    "op8_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op9_quality_rules": {
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    },
    "op10_simhash": {"doc_id", "fingerprint", "component_id"},
    "op11_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op12_superminhash": {"doc_id", "n_shingles", "component_id", "kept"},
    "op13_periodic_runs": {
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    },
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_have_the_agreed_columns_and_rows(spark, name):
    result = entry.queries()[name](spark, SF)
    assert COLUMNS[name] <= set(result.columns)
    table = "pages" if "page_id" in result.columns else "documents"
    rows, key = result.count(), "page_id" if table == "pages" else "doc_id"
    expected = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name != "op7_line_dedup":
        assert rows == expected * (2 if name == "op4_warc" else 1)
        assert result.select(key).distinct().count() == expected
    assert set(QUERIES) == set(COLUMNS)


def test_mixing_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.execute(entry.oracle_sql()["op8_mixing"])
    order = [d[0] for d in sql.description]
    assert sorted(sql.fetchall()) == sorted(map(tuple, QUERIES["op8_mixing"](spark, SF).select(order).collect()))


def held_against_rules(texts, trusted):
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def weight(b):
        expected = max(raw[b] - 1, 0) * n_target / n_raw
        ratio = (target[b] + quality_rules.SMOOTHING) / (expected + quality_rules.SMOOTHING)
        return math.floor(math.log(ratio) * quality_rules.UNIT + 0.5)

    kept, unsure = set(), set()
    for i, t in texts.items():
        n, _, _, _, repeated = base(t)
        found = grams(t)
        ratio = sum(map(weight, found)) / len(found) / quality_rules.UNIT if found else 0.0
        if n >= 50 and 100 * repeated <= 50 * n and ratio >= quality_rules.THRESHOLD:
            kept.add(i)
        if abs(ratio - quality_rules.THRESHOLD) < 1e-5:
            unsure.add(i)
    return kept, unsure


def without_lines(texts):
    """Documents in order of id, without lines that repeat or nearly repeat an earlier one."""
    rows = [(i, j, x) for i, t in sorted(texts.items()) for j, x in enumerate(t.split("\n")) if WORD.search(x)]
    texts_of = list(dict.fromkeys(x for _, _, x in rows))
    bags = {x: Counter(x) for x in texts_of}
    root = {x: x for x in texts_of}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_length = {}
    for x in texts_of:
        for n in range(len(x) - 2, len(x) + 3):
            for y in by_length.get(n, []):
                differ = sum((bags[x] - bags[y]).values()) + sum((bags[y] - bags[x]).values())
                n_edits = allowed(min(len(x), len(y)))
                if abs(len(x) - len(y)) <= n_edits and differ <= 2 * n_edits and edits(x, y) <= n_edits:
                    root[find(x)] = find(y)
        by_length.setdefault(len(x), []).append(x)
    seen, gone = set(), set()
    for i, j, x in rows:
        if find(x) in seen:
            gone.add((i, j))
        seen.add(find(x))
    return {i: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in texts.items()}


def test_every_stage_matches_brute_force_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"
    ]
    quality, lines, near, mixture, tokens = (stage for _, stage in corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()

    kept = quality(spark, docs, SF)
    expected, unsure = held_against_rules(texts, {r.doc_id for r in labels})
    assert {r.doc_id for r in kept.collect()} - unsure == expected - unsure
    assert kept.columns == docs.columns

    before = {r.doc_id: r.text for r in kept.collect()}
    thinned = lines(spark, kept, SF)
    after = {r.doc_id: r.text for r in thinned.collect()}
    assert after == without_lines(before) and thinned.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in thinned.collect())

    single = near(spark, thinned, SF)
    ids = sorted(after)
    groups = brute_groups([brute_fp(after[i]) for i in ids])
    assert sorted(r.doc_id for r in single.collect()) == [ids[k] for k in sorted(set(groups))]
    assert single.columns == docs.columns

    con = duckdb.connect()
    con.register("documents", single.toPandas())
    copies = Counter({r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({MIXING})").fetchall() if r[1]})
    mixed = mixture(spark, single, SF)
    assert Counter(r.doc_id for r in mixed.collect()) == copies and mixed.columns == docs.columns

    rows = tokens(spark, mixed, SF).collect()
    assert len(rows) == sum(copies.values())
    for r in rows:
        ids = library(after[r.doc_id])
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(copies.elements())


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd_docs, no_docs):
            out = stage(spark, table, SF)
            assert out.count() <= 3 * table.count()
            if name != "sentencepiece":
                assert out.columns == table.columns
