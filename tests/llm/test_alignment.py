"""Alignment and corpus counts against encoding whole texts and counting every link."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from listingloom.llm import alignment as a
from listingloom.llm.queries import QUERIES, byte_model, piece_model

SF = "/root/testdata/sf0.001"
# The byte-level characters of GPT-2's vocabulary, as the decoder of the library has them.
OURS = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OURS.encode_special_tokens = True
THEIRS = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def visible():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


VISIBLE = visible()


def piece_bytes(i):
    piece = THEIRS.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if THEIRS.is_byte(i) else piece.replace("▁", " ").encode()


def tokens(text):
    if not text:
        return None
    x, y = OURS.encode(f" {text}", add_special_tokens=False).ids, THEIRS.encode(text)
    x_bytes, y_bytes = [bytes(VISIBLE[c] for c in OURS.id_to_token(i)) for i in x], list(map(piece_bytes, y))
    if b"".join(x_bytes) != f" {text}".encode() or b"".join(y_bytes) != f" {text}".encode():
        return None

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    return x, ranges(x_bytes), y, ranges(y_bytes)


def brute(rows):
    corpus, own = Counter(), []
    for i, text in rows:
        found = tokens(text)
        if found is None:
            own.append((i, 0, 0, 0, [], ""))
            continue
        x, xr, y, yr = found
        links, at = [], 0
        for j, (s, e) in enumerate(yr):
            while at and xr[at - 1][1] > s:
                at -= 1
            while xr[at][1] <= s:
                at += 1
            k = at
            while k < len(xr) and xr[k][0] < e:
                links.append((y[j], x[k]))
                k += 1
        ends = sorted({e for _, e in xr} & {e for _, e in yr})
        groups, start = [], 0
        for end in ends:
            part = lambda ids, rs: ",".join(str(t) for t, (s, e) in zip(ids, rs) if start <= s and e <= end)  # noqa: E731, B023
            groups.append(f"{part(x, xr)}|{part(y, yr)}")
            start = end
        corpus.update(links)
        own.append((i, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (b, _), n in corpus.items():
        top[b] = max(top[b], n)
    return [
        (i, n, m, g, len(links), sum(corpus[p] == top[p[0]] for p in links), sum(corpus[p] for p in links), sha)
        for i, n, m, g, links, sha in own
    ]


def result(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(str, map(tuple, df.select(names).collect())))


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, (r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(QUERIES["op11_alignment"](spark, SF)) == sorted(map(str, brute(docs)))


ODD = [
    "a  b", "  a", " ", "  ", "a ", "\n a", "a\n b", "a   b", "a　  b", "▁x y", "x▁", "<s> </s>", "<0x0A>",
    "<|endoftext|> a", "é ü  ß", "中文 字", "퟿ 🙂 x", "a\tb  \t c", "x​  y", "a\x85  b", "a\x1c  b", "\x00 b",
    "it's don't we'll  'tis", "123  456,,, ...   !!!", "a" * 500, "᠎  x", "﻿  z", "a­  b", None, "", "dup dup", "dup dup",
]


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts_in_many_runs(spark, monkeypatch, small):
    if small:  # runs of a few links, merged in several levels, pieces forgotten on the way
        # Workers get the module by name: what is patched here must be read on the driver.
        monkeypatch.setattr(a, "FAN", 2)
    rnd = random.Random(3)
    letters = " " * 6 + "ab'sé\n\t 　​ \x1c\x85▁中🙂1,.<>|́\x0b\x00᠎ ⁠﻿­؜"
    texts = ODD + ["".join(rnd.choices(letters, k=rnd.randint(1, 30))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(a.aligned(df, byte_model(), piece_model())) == sorted(map(str, brute(rows)))


def test_runs_hold_every_document_and_merge_by_a_heap(spark, words):
    pair = a.Pair(byte_model(), piece_model())
    blocks, expected = [], Counter()
    for i in range(40):
        _, counts, links = a.align(pair, [f" {w}" for w in words(9, i).split()] + [" a\u2581"])
        assert counts[-1].tolist() == [-1, 0, 0, 0] and counts[:-1, 3].sum() == len(links)
        own = Counter(links.tolist())
        expected.update(own)
        keys = sorted(own)
        blocks.append(a._packed(a._steps(np.array(keys)), np.array([own[k] for k in keys])))
    assert list(a._merged(blocks)) == sorted(expected.items())
    df = spark.createDataFrame([(i, words(60, i % 50)) for i in range(300)], "doc_id long, text string").repartition(3)
    rows = a.runs_of(df, byte_model(), piece_model()).collect()
    assert sorted(d.doc_id for r in rows for d in r.docs) == list(range(300))


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    df = a.aligned(odd_docs, byte_model(), piece_model())
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert result(df) == sorted(map(str, brute(rows)))
    assert a.aligned(no_docs, byte_model(), piece_model()).collect() == []
