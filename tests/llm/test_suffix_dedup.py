import hashlib
import random
from collections import Counter

from listingloom.llm import suffix_dedup as s

L = s.LENGTH


def expected(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + L] for b in data for i in range(len(b) - L + 1))
    out = []
    for (i, _), b in zip(rows, data):
        spans = s.merged([(p, p + L) for p in range(len(b) - L + 1) if seen[b[p : p + L]] > 1])
        kept = s._cut(b, [x for x, _ in spans], [y for _, y in spans])
        out.append((i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(table):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in s.removed(table).select(cols).collect()), key=repr)


def test_planted_repeats_match_brute_force(docs, words):
    rnd = random.Random(4)
    shared = [words(120, i) for i in range(12)]
    texts = []
    for i in range(120):
        parts = [words(rnd.randint(5, 150), 1000 + 10 * i + k) for k in range(3)]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(shared)
            start = rnd.randint(0, 80)
            parts.insert(rnd.randint(0, len(parts)), p[start : start + rnd.randint(380, 460)])
        texts.append("".join(parts))
    texts += [texts[3], texts[3], texts[5][:-1] + "#", "x" + texts[7]]
    assert got(docs(texts)) == expected(list(enumerate(texts)))


def test_periodic_and_odd_texts(odd_docs, no_docs, docs, words):
    texts = ["ab" * 500, "abc" * 400, "z" * 399, "z" * 400, "q" * 401, words(90, 1) * 3, "é" * 200, "é" * 200 + "!", "x" + "é" * 200]
    assert got(docs(texts)) == expected(list(enumerate(texts)))
    assert got(odd_docs) == expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert got(no_docs) == []


def test_very_long_texts_are_read_in_parts(monkeypatch, docs, words):
    monkeypatch.setattr(s, "_PART", 1000)
    texts = [words(700, 1), words(300, 2) + words(700, 1)[50:2500], words(300, 3) + words(200, 2)]
    data = [t.encode() for t in texts]
    every = sorted(p for a, lo, hi in s.suffixes(data[0]) for p in range(a - hi, a - lo + 1))
    assert every == list(range(len(data[0]) - L + 1))
    assert got(docs(texts)) == expected(list(enumerate(texts)))
