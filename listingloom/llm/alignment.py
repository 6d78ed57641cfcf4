"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often.

Texts are cut where neither tokenizer joins across: before a space that follows a visible
character. Equal pieces are tokenized and aligned once. Tokens whose byte ranges overlap are
linked; links are counted over the whole corpus for each pair of ids, by external spill counting:

- A task gathers the records (pair of ids, document, links) of some documents, sorts them by the
  second vocabulary's id, then the first's, and writes them as one compressed run; the pairs of the
  run and their counts are cut by radix of the second id and written as compressed runs too.
- The runs of one radix are merged by a heap, a bounded number at a time, level by level, until
  one is left. It holds each pair's count, and as it is in order of the second id, its
  highest count is known when the id ends.
- What the merge found goes back along the same runs, each pair once a run, and each run then
  adds up what its documents have of it.

A pair that stands in every document is thus moved once per run, not once per document, and no
task holds more than a bounded number of runs, or the counts of one radix, which the vocabularies bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from listingloom.llm.tables import stored

SPACE = "▁"
#: Links of the documents of one run (a document is never parted), and pieces that are remembered.
RUN_LINKS = 400_000
REMEMBERED = 200_000
#: Parts by radix of the second id, and runs of one that are merged at a time.
RADIX = 32
FAN = 128
# A space stands apart from what precedes it if that is none of these. What any
# tokenizer may take for white space; to name too much only makes longer pieces.
_WHITE = r"\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
_PIECE = re.compile(rf" (?:[^ ]+|(?<=[{_WHITE}]) )*")


def _byte_of_char() -> dict[str, int]:
    """The bytes behind the visible characters of a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the other bytes, in order, for U+0100 and on.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: What the byte-level pre-tokenizer takes apart (a fixed value of that kind of vocabulary).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_level_encoder(spec: dict) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts by a byte-level tokenizer's JSON; special tokens in texts are plain text.

    Where ids are in order of merges, which is what ranks say, the faster library for ranks is used.
    """
    model, table = spec["model"], _byte_of_char()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pre = spec["pre_tokenizer"] or {}
    plain = not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
    n = len(table)
    ranked = all(model["vocab"].get(a + b) == n + k for k, (a, b) in enumerate(merges)) and len(model["vocab"]) == n + len(merges)
    if plain and ranked:
        ranks = {bytes(table[c] for c in piece): i for piece, i in model["vocab"].items()}
        coder = tiktoken.Encoding("pieces", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]
    coder = tokenizers.Tokenizer.from_str(json.dumps(spec))
    coder.encode_special_tokens = True
    return lambda texts: [e.ids for e in coder.encode_batch(texts, add_special_tokens=False)]


class _Side:
    """Bytes, their number, and the text of each id of one vocabulary."""

    def __init__(self, bytes_of: list[bytes], last: str):
        self.bytes_of = bytes_of
        self.width = np.array([len(x) for x in bytes_of], np.int64)
        # Every id followed by what parts it from the next of its group, or from the other side or group.
        self.shown = np.array([f"{i}{mark}" for i in range(len(bytes_of)) for mark in (",", last)], object)


class Pair:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, byte_level: str, merge_type: bytes):
        spec, table = json.loads(byte_level), _byte_of_char()
        vocabulary = spec["model"]["vocab"]
        self.encode_a = _byte_level_encoder(spec)
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            a_bytes[i] = bytes(table[c] for c in piece)
        self.a = _Side(a_bytes, "|")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=merge_type)
        model = model_pb2.ModelProto()
        model.ParseFromString(merge_type)
        if any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces if p.type == 1):
            raise ValueError("pieces across words: texts can't be cut")
        self.b = _Side(
            [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for p in model.pieces], ";"
        )
        self.b_space = self.library.piece_to_id(SPACE)

    def tokens(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each piece, which begins with a space; what the second adds is that space."""
        theirs = self.library.encode([p[1:] for p in pieces], num_threads=1)
        return self.encode_a(pieces), [y if len(p) > 1 else [self.b_space] for p, y in zip(pieces, theirs)]


def align(pair: Pair, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each piece: its groups as text; tokens of both, groups and links; links ``b << 32 | a``.

    The counts are -1, 0, 0, 0 where the tokens of either don't have the bytes of the piece. The
    pieces are laid side by side and parted at all places where a token of either ends: between two
    such places stands one link, and a place where both end ends a group.
    """
    ids = pair.tokens(pieces)
    data = [p.encode("utf-8", "surrogatepass") for p in pieces]
    sides = (pair.a, pair.b)
    sound = np.ones(len(pieces), bool)
    for side, lists in zip(sides, ids):
        of = side.bytes_of
        sound &= np.array([b"".join([of[i] for i in x]) == d for x, d in zip(lists, data)], bool)
    which = np.flatnonzero(sound)
    n = [np.array([len(lists[i]) for i in which], np.int64) for lists in ids]
    flat = [np.fromiter((t for i in which for t in lists[i]), np.int64, int(k.sum())) for lists, k in zip(ids, n)]
    ends = [np.cumsum(side.width[x]) for side, x in zip(sides, flat)]
    places = np.union1d(*ends)
    at = [np.searchsorted(e, places) for e in ends]
    links = flat[1][at[1]] << 32 | flat[0][at[0]]
    owner = np.repeat(np.arange(len(which)), n[0])[at[0]]
    closed = (ends[0][at[0]] == places) & (ends[1][at[1]] == places)
    groups = places[closed]
    group = [np.searchsorted(groups, e) for e in ends]
    last = [(e == groups[g]).astype(np.int64) for e, g in zip(ends, group)]
    many = [np.cumsum(np.bincount(g, minlength=len(groups))) for g in group]
    out = np.empty(len(flat[0]) + len(flat[1]), object)
    before = np.r_[0, many[1]][group[0]]  # tokens of the other side that come first
    out[np.arange(len(flat[0])) + before] = sides[0].shown[2 * flat[0] + last[0]]
    out[np.arange(len(flat[1])) + many[0][group[1]]] = sides[1].shown[2 * flat[1] + last[1]]
    parts, stops = out.tolist(), np.cumsum(n[0] + n[1]).tolist()
    shown = [""] * len(pieces)
    for i, start, stop in zip(which.tolist(), [0, *stops], stops):
        shown[i] = "".join(parts[start:stop])[:-1]
    counts = np.zeros((len(pieces), 4), np.int64)
    counts[:, 0] = -1
    own = np.bincount(owner, minlength=len(which)), np.bincount(owner[closed], minlength=len(which))
    counts[which] = np.stack([n[0], n[1], own[1], own[0]], axis=1)
    return shown, counts, links


class _Pieces:
    """What is known of pieces: numbered, with counts, text of groups and links of each."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of both, groups, links; -1: bytes differ
        self.links = np.zeros(0, np.int64)  # of all pieces, one after the other

    def learn(self, pieces: set[str]) -> None:
        new = sorted(p for p in pieces if p not in self.number)
        if not new:
            return
        shown, counts, links = align(self.pair, new)
        self.number.update(zip(new, range(len(self.shown), len(self.shown) + len(new))))
        self.shown += shown
        self.counts = np.concatenate([self.counts, counts])
        self.links = np.concatenate([self.links, links])


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one compressed block; sorted ones should come as differences."""
    out = []
    for x in arrays:
        x = x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
        out.append(f"{x.dtype.str},{len(x)};".encode() + x.tobytes())
    return zstandard.compress(b"".join(out), 1)


def _unpacked(block: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(block), 0, []
    while at < len(data):
        head = data.index(b";", at)
        kind, n = data[at:head].split(b",")
        out.append(np.frombuffer(data, np.dtype(kind.decode()), int(n), head + 1))
        at = head + 1 + out[-1].nbytes
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype(np.uint64)


def _pairs_of(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = _unpacked(block)
    return np.cumsum(steps.astype(np.int64)), counts.astype(np.int64)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


DOCS = "array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>"
RUN = f"run string, docs {DOCS}, records binary, pairs array<struct<radix:int,block:binary>>"


def runs_of(docs: DataFrame, byte_level: str, merge_type: bytes) -> DataFrame:
    """A row per run: its documents, their records, and the counts of its pairs by radix."""
    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(RUN)]
    names = [f.name for f in StructType.fromDDL(RUN)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(Pair(byte_level, merge_type))
        task = TaskContext.get()
        done = 0
        own: list[tuple] = []  # a row for each document of the run
        used: list[tuple[np.ndarray, np.ndarray]] = []  # its pieces and how often it has each
        links = 0

        def flush() -> pa.RecordBatch:
            nonlocal done, links
            sizes = [len(p) for p, _ in used]
            which = np.concatenate([p for p, _ in used])
            times = np.concatenate([t for _, t in used])
            doc = np.repeat(np.arange(len(used)), sizes)
            each = pieces.counts[:, 3]
            n = each[which]
            begin = np.cumsum(each) - each
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[which], n)
            pair, whose = np.unique(pieces.links[at], return_inverse=True)
            bits = max(1, len(own).bit_length())
            key, count = _summed(whose.astype(np.int64) << bits | np.repeat(doc, n), np.repeat(times, n))
            place, doc = key >> bits, key & ((1 << bits) - 1)
            records = _packed(_steps(place), doc, count)
            total = np.bincount(place, count, len(pair)).astype(np.int64)  # exact: far below 2^53
            radix = (pair >> 32) % RADIX
            parts = [
                {"radix": r, "block": _packed(_steps(pair[radix == r]), total[radix == r])} for r in np.unique(radix).tolist()
            ]
            name = f"{task.partitionId() if task else 0}-{done}"
            listed = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), d)) for d in own]
            rows = [[name], [listed], [records], [parts]]
            done, links = done + 1, 0
            own.clear()
            used.clear()
            if len(pieces.number) > REMEMBERED:
                pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                cut = [_PIECE.findall(f" {t}") if t else [] for t in some.column("text").to_pylist()]
                pieces.learn(set().union(*cut))
                for doc_id, parts in zip(some.column("doc_id").to_pylist(), cut):
                    numbers = np.fromiter(map(pieces.number.__getitem__, parts), np.int64, len(parts))
                    mine, times = np.unique(numbers, return_counts=True)
                    sums = (pieces.counts[mine] * times[:, None]).sum(axis=0).tolist()
                    if not parts or (pieces.counts[mine, 0] < 0).any():
                        own.append((doc_id, 0, 0, 0, 0, ""))
                        used.append((mine[:0], times[:0]))
                    else:
                        text = ";".join([pieces.shown[i] for i in numbers.tolist()])
                        own.append((doc_id, *sums, hashlib.sha256(text.encode()).hexdigest()))
                        used.append((mine, times))
                        links += sums[3]
                    if links >= RUN_LINKS or len(own) >= 1 << 16:
                        yield flush()
                        if not pieces.number:  # forgotten: the rest of the slice is learnt anew
                            pieces.learn(set().union(*cut))
        if own:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RUN)


def _merged(blocks: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, count) in order of several sorted runs, by a heap over their next pairs."""
    runs = (zip(*(x.tolist() for x in _pairs_of(b))) for b in blocks)
    last, count = -1, 0
    for pair, n in heapq.merge(*runs, key=itemgetter(0)):
        if pair != last:
            if last >= 0:
                yield last, count
            last, count = pair, 0
        count += n
    if last >= 0:
        yield last, count


def _counted(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.array(list(_merged(blocks)), np.int64).reshape(-1, 2)
    return rows[:, 0], rows[:, 1]


def counts_of(parts: DataFrame, runs: int) -> DataFrame:
    """``radix, block``: one run per radix with the counts over all ``parts`` (run, radix, block).

    At most about ``FAN`` runs are merged at a time; as each level is written, a lost executor
    costs one level's task.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = _counted(rows["block"].tolist())
        name = min(rows["run"])
        return pd.DataFrame({"run": [name], "radix": [rows["radix"].iloc[0]], "block": [_packed(_steps(pairs), counts)]})

    while True:
        shares = -(-runs // FAN)
        share = F.pmod(F.xxhash64("run"), F.lit(shares)).alias("share")
        merged = parts.groupBy("radix", share).applyInPandas(merge, "run string, radix int, block binary")
        if shares == 1:
            return merged.select("radix", "block")
        parts, runs = stored(merged, "merged"), shares


def _answered(parts: DataFrame, totals: DataFrame, runs: int) -> DataFrame:
    """``run, radix, block``: for each pair of a run, in its order, the corpus count and whether it is its id's best."""

    def answer(some: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = _pairs_of(total["block"].iloc[0])
        side = pairs >> 32  # in order: an id's pairs stand together
        first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
        top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.r_[first, len(side)]))
        best = (counts == top).astype(np.uint8)
        out = []
        for block in some["block"]:
            at = np.searchsorted(pairs, _pairs_of(block)[0])
            out.append(_packed(counts[at], best[at]))
        return pd.DataFrame({"run": some["run"], "radix": some["radix"], "block": out})

    shares = -(-runs // FAN)
    mine = parts.withColumn("share", F.pmod(F.xxhash64("run"), F.lit(shares)))
    theirs = totals.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
    both = mine.groupBy("radix", "share").cogroup(theirs.groupBy("radix", "share"))
    return both.applyInPandas(answer, "run string, radix int, block binary")


def aligned(docs: DataFrame, byte_level: str, merge_type: bytes) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document.

    The first tokenizer (a JSON of byte-level kind) reads a space and the text, the second (a model of
    merge type with byte fallback and a dummy prefix) the text. Texts that are null or empty, or that
    either doesn't give back byte for byte, have zeros and an empty digest and count nowhere. A pair's
    count is how many links of the corpus hold it; ``n_best`` are the links whose count is the highest
    of their second id, ``count_sum`` adds counts over links. Repeated rows and ids count each;
    an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
    """
    runs = stored(runs_of(docs, byte_level, merge_type), "runs")
    n = max(1, runs.count())
    parts = runs.select("run", F.inline("pairs"))
    totals = stored(counts_of(parts, n), "totals")
    answers = stored(_answered(parts, totals, n), "answers").groupBy("run").agg(
        F.collect_list(F.struct("radix", "block")).alias("answers")
    )
    both = runs.join(answers, "run", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own = row["docs"]
                steps, doc, count = (x.astype(np.int64) for x in _unpacked(row["records"]))
                found = {x["radix"]: _unpacked(x["block"]) for x in row["answers"] or []}
                # Pairs of the run in its own order: by second id over all radixes.
                side = {p["radix"]: _pairs_of(p["block"])[0] for p in row["pairs"]}
                pairs = np.concatenate([*side.values(), np.zeros(0, np.int64)])
                order = np.argsort(pairs, kind="stable")
                totals_, best = (
                    np.concatenate([*(found[r][k].astype(np.int64) for r in side), np.zeros(0, np.int64)])[order] for k in (0, 1)
                )
                place = np.cumsum(steps)
                n_best, sums = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                np.add.at(n_best, doc, count * best[place])
                np.add.at(sums, doc, count * totals_[place])
                columns = [pa.array([d[c] for d in own]) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                columns = [c.cast(pa.int64()) for c in columns] + [pa.array(n_best), pa.array(sums)]
                columns.append(pa.array([d["groups_sha256"] for d in own], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in names)
    return both.mapInArrow(add, kinds)
