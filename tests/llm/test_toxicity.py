import random
import zlib

import numpy as np
import pytest

from listingloom.llm import toxicity as t

TERMS = (("women", "men", "muslims"),)


def biased(words, n=400):
    """Insults are toxic; one group is named in toxic texts only, others in harmless ones."""
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        group = "muslims" if toxic else rnd.choice(["women", "men", ""])
        insult = rnd.choice(["idiot", "scum", "trash"]) if toxic and rnd.random() < 0.85 else ""
        rows.append((f"{words(12, i)} {group} {insult}.", int(toxic)))
    return rows


def fitted(rows, penalty):
    changes = [c for text, _ in rows for c in t.counterfactuals(text, TERMS)]
    return t.fit([sorted(t.features(x)) for x, _ in rows], [y for _, y in rows], changes, penalty)


def test_penalty_takes_the_bias_off_neutral_mentions(words):
    rows = biased(words)
    plain, fair = fitted(rows, 0.0), fitted(rows, 5.0)
    neutral = [t.features(f"{words(10, 900 + i)} muslims {words(3, i)}") for i in range(50)]
    mean = lambda model: np.mean([model.score(x) for x in neutral])
    assert mean(fair) < 0.5 * mean(plain)
    gap = lambda model: abs(model.score(t.features("the muslims came")) - model.score(t.features("the men came")))
    assert gap(fair) < 0.3 * gap(plain)
    assert fair.score(t.features("you idiot and trash")) > 0.5


def test_counterfactuals_change_the_term_alone():
    pairs = list(t.counterfactuals("The women left. The Men stayed!", TERMS))
    assert len(pairs) == 4
    before, after = pairs[0]
    assert before <= t.features("women") and after <= t.features("men muslims") and before and after
    assert not list(t.counterfactuals("nobody", TERMS))


def test_held_out_accuracy_and_no_peeking(spark, docs, words):
    rows = biased(words, 800)
    table = docs([x for x, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = t.scores(t.held_out(table), t.train(table, labels), ["doc_id", "held_out"]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == rows[r.doc_id][1] for r in held]) > 0.9
    flipped = spark.createDataFrame(
        [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, (_, y) in enumerate(rows)],
        "doc_id long, quality int, toxic int",
    )
    again = t.scores(t.held_out(table), t.train(table, flipped), ["doc_id"]).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx({r.doc_id: r.score for r in again})


def test_odd_rows_and_missing_classes(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = t.train(odd_docs, none)
    rows = t.scores(odd_docs, model, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count() and {r.predicted for r in rows} == {0}
    assert t.scores(no_docs, model, ["doc_id"]).count() == 0
    every = spark.createDataFrame([(i, None, 1) for i in range(9)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in t.scores(odd_docs, t.train(odd_docs, every), []).collect()} == {1}
