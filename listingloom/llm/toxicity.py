"""Toxicity: a counterfactual-regularised linear classifier.

Texts are sets of hashed words and word beginnings, weighed by how much likelier they are under
label 1, and a logistic model is fitted on them. Sentences of the labelled texts that name a
group of people are rewritten to name each other group of the same kind, and the square of the
change of score is penalised, so that the mention of a group doesn't count as toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on, at most (least hash of id).
TRAINING_BOUND = 8000
FEATURES = 1 << 20
#: Features found in fewer training texts are left out.
MIN_TEXTS = 4
#: Strength of the penalties on weights and on changes of score.
RIDGE = 1e-3
COUNTERFACTUAL = 1.0
STEPS = 200

#: Words for groups of people, by kind and language; those of one line can take each other's place.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features_of(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its beginnings of 3 to 5 letters."""
    parts = {"=" + word} | {"^" + word[:n] for n in (3, 4, 5) if len(word) > n}
    return tuple(xxhash.xxh32_intdigest(p.encode()) % FEATURES for p in sorted(parts))


def features(text: str) -> set[int]:
    return {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}


def counterfactuals(
    text: str, terms: Sequence[Sequence[str]] = IDENTITY_TERMS
) -> Iterator[tuple[set[int], set[int]]]:
    """For each sentence that names a group: features of it that another group's name takes away, and adds."""
    others = {t: [o for o in kind if o != t] for kind in terms for t in kind}
    lower = text.lower()
    if not any(t in lower for t in others):
        return
    for sentence in _SENTENCE.findall(lower):
        words = _WORD.findall(sentence)
        for term in {w for w in words if w in others}:
            before = features(sentence)
            for other in others[term]:
                after = features(" ".join(other if w == term else w for w in words))
                yield before - after, after - before


class Model:
    """Weights by feature and an offset."""

    def __init__(self, weights: dict[int, float], offset: float):
        self.weights = weights
        self.offset = offset

    def score(self, found: set[int]) -> float:
        total = self.offset + sum(sorted(self.weights[f] for f in found if f in self.weights))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit(
    texts: Sequence[Sequence[int]], toxic: Sequence[int], changes: Sequence[tuple[Sequence[int], Sequence[int]]],
    penalty: float = COUNTERFACTUAL,
) -> Model:
    """Fits the model; with one class only, or no text, every score is that class's share (or 0)."""
    y = np.asarray(toxic, float)
    if not 0 < y.sum() < len(y):
        share = y.mean() if len(y) else 0.0
        return Model({}, 30.0 if share else -30.0)
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    every = np.concatenate([np.asarray(t, np.int32) for t in texts])
    counts = np.bincount(every, minlength=FEATURES)
    names = np.flatnonzero(counts >= MIN_TEXTS)
    place = np.full(FEATURES, -1, np.int32)
    place[names] = np.arange(len(names))
    cols = place[every]
    keep = cols >= 0
    rows, cols = rows[keep], cols[keep]
    del every, keep, texts
    k, n = len(names), len(y)
    pos = np.bincount(cols, y[rows], k)
    neg = np.bincount(cols, minlength=k) - pos
    lean = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / (n - y.sum() + 2))
    x = lean[cols]

    at = {int(f): i for i, f in enumerate(names)}
    signed = [
        (r, at[f], s) for r, (minus, plus) in enumerate(changes) for s, fs in ((-1, minus), (1, plus)) for f in fs if f in at
    ]
    d_rows, d_cols, d_sign = (np.array(c, np.int64) for c in (zip(*signed) if signed else ((), (), ())))
    d_x, m = d_sign * lean[d_cols], max(1, len(changes))

    def slope(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, x * w[cols], n) + b, -30, 30)))
        g = np.bincount(cols, x * (p - y)[rows], k) / n + RIDGE * w
        if len(signed):
            change = np.bincount(d_rows, d_x * w[d_cols], m)
            g += 2 * penalty / m * np.bincount(d_cols, d_x * change[d_rows], k)
        return g, float((p - y).mean())

    v, curve = np.ones(k), 1.0
    for _ in range(20):  # the largest curvature, by power iteration
        v /= np.linalg.norm(v)
        u = np.bincount(cols, x * np.bincount(rows, x * v[cols], n)[rows], k) / (4 * n)
        if len(signed):
            u += 2 * penalty / m * np.bincount(d_cols, d_x * np.bincount(d_rows, d_x * v[d_cols], m)[d_rows], k)
        curve, v = np.linalg.norm(u), u
    step = 1 / (1.1 * curve + RIDGE)
    w, ahead, t = np.zeros(k), np.zeros(k), 1.0
    b = float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(STEPS):
        g, gb = slope(ahead, b)
        new = ahead - step * g
        b -= gb
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return Model({int(f): float(a) for f, a in zip(names, w * lean) if abs(a) > 1e-9}, b)


def held_out(docs: DataFrame) -> DataFrame:
    """Adds ``held_out``: rows whose id may not be learned from."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_BOUND) -> Model:
    """Fits on at most ``bound`` labelled documents that aren't held out, chosen by hash of id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = held_out(known).where("not held_out").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "toxic")), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            changes = [list(counterfactuals(t)) for t in texts]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "toxic": batch["toxic"],
                    "found": [sorted(features(t)) for t in texts],
                    "minus": [[sorted(a) for a, _ in c] for c in changes],
                    "plus": [[sorted(b) for _, b in c] for c in changes],
                }
            )

    schema = "doc_id long, toxic int, found array<int>, minus array<array<int>>, plus array<array<int>>"
    rows = chosen.mapInPandas(run, schema).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    changes = [c for minus, plus in zip(rows["minus"], rows["plus"]) for c in zip(minus, plus)]
    return fit(rows["found"].tolist(), rows["toxic"].tolist(), changes)


def scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` of every document; null texts are empty.

    Every text is scored as a whole from its own words, so repeated rows score alike; an
    empty text has the score of the offset.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            out = []
            for text in texts:
                found: set[int] = set()
                for w in set(_WORD.findall((text or "").lower())):
                    if (f := known.get(w)) is None:
                        if len(known) >= 300_000:
                            known.clear()
                        f = known[w] = tuple(x for x in features_of(w) if x in model.weights)
                    if f:
                        found.update(f)
                out.append(model.score(found))
            yield pd.Series(out, dtype="float64")

    udf = F.pandas_udf(run, "double")
    return docs.select(*keep, udf(F.col("text").cast("string")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
