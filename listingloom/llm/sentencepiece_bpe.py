"""SentencePiece encoding and decoding for vocabularies of merge type.

Adjacent symbols whose join is a piece go on an agenda ordered by the piece's score, then by
place; the best is joined until none is left. Texts are cut where no piece can reach across,
equal chunks are encoded once per batch, and the agendas of all chunks of one length advance
together: every round joins one pair of each. Each batch's new chunks and all decoded texts are
checked against the sentencepiece library; a difference fails the job.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from listingloom.llm.tables import by_slices

SPACE = "▁"
_MARKS = r"!-/:-@\[-`{-~"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Chunks that are remembered within a task, and characters that are worked on at a time.
REMEMBERED = 300_000
AT_ONCE = 2_000_000
#: Characters of text whose ids a task holds as a whole.
SLICE = 500_000
#: Longer chunks have an agenda of their own.
TOGETHER = 48
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces and pairs of a model of merge type, and the library's processor for checks."""

    def __init__(self, model: bytes):
        spec = model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not plain:
            raise ValueError("a merge-type model with identity normalization and a dummy prefix is needed")
        if spec.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in spec.pieces):
            raise ValueError("no white space suffixes or user-defined pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = self.library.eos_id()
        self.unknown = self.library.unk_id()
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.of_byte = {i: b for b, i in self.byte.items()}
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (1, 5)}
        self.shown = [
            p.piece.replace(SPACE, " ") if p.type in (1, 5) else spec.trainer_spec.unk_surface if p.type == 2 else ""
            for p in spec.pieces
        ]
        # Symbols: ids of pieces; characters without a piece of their own come after them.
        self.size = len(spec.pieces)
        self.char = np.arange(0x110000, dtype=np.int32) + self.size
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        # Equal scores are told apart by place only, so they share a rank.
        ranks = {s: r for r, s in enumerate(sorted({p.score for p in spec.pieces}, reverse=True))}
        symbol = lambda s: int(self.char[ord(s)]) if len(s) == 1 else normal.get(s)
        pairs = []
        for piece, i in normal.items():
            for at in range(1, len(piece)):
                left, right = symbol(piece[:at]), symbol(piece[at:])
                if left is not None and right is not None:
                    pairs.append((left * self._base + right, i, ranks[spec.pieces[i].score]))
        pairs.sort()
        self.keys, self.joined, self.rank = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.pair = {k: (r, j) for k, j, r in pairs}
        long = [p for p in normal if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            raise ValueError("pieces across words: texts can't be cut into chunks")
        alone = "".join(c for c in "\t\n\r" if not any(c in p for p in long))
        if "\n" not in alone:
            raise ValueError("pieces across lines: chunks can't be told apart")
        cut = re.escape(alone)
        chunk = f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+|[{cut}]"
        if not any(re.search(f"[{_LETTERS}][{_MARKS}]", p) for p in long):
            # A word is told apart from the mark that follows it: fewer different chunks.
            chunk = f"{SPACE}*[{_LETTERS}]+(?=[{_MARKS}])|{chunk}"
        self.chunk = re.compile(chunk)

    @property
    def _base(self) -> int:
        return self.size + 0x110000

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _ids(self, symbols: Iterable[int]) -> tuple[int, ...]:
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            elif self.byte:
                out.extend(self.byte[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return tuple(out)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self._base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), self.joined[at]

    def agenda(self, chunk: str) -> tuple[int, ...]:
        """One chunk, with a heap of its pairs; what a join has made stale is skipped."""
        symbols = [int(self.char[ord(c)]) for c in chunk]
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def put(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.pair.get(symbols[i] * self._base + symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(len(symbols)):
            put(i)
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = joined, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            put(i)
            if before[i] >= 0:
                put(before[i])
        return self._ids(s for s in symbols if s >= 0)

    def _together(self, chunks: list[str]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Place in ``chunks`` and ids; all of one length."""
        n, width = len(chunks), len(chunks[0])
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char[points].reshape(n, width)
        rows = np.arange(n)
        rank, joined = self._ranked(sym[:, :-1], sym[:, 1:])
        while True:
            if width > 1:
                best = rank.argmin(axis=1)
                go = rank[np.arange(len(rows)), best] < _NONE
            else:
                go = np.zeros(len(rows), bool)
            plain = sym[~go]
            if len(plain):
                odd = (plain >= self.size).any(axis=1)
                for row, ids, o in zip(rows[~go].tolist(), plain.tolist(), odd.tolist()):
                    yield row, self._ids(ids) if o else tuple(ids)
            if not go.any():
                return
            rows, sym, rank, joined, best = rows[go], sym[go], rank[go], joined[go], best[go]
            each, n = np.arange(len(rows)), len(rows)
            sym[each, best] = joined[each, best]
            keep = np.ones(sym.shape, bool)
            keep[each, best + 1] = False
            sym = sym[keep].reshape(n, width - 1)
            keep = np.ones(rank.shape, bool)
            keep[each, best] = False
            rank, joined = rank[keep].reshape(n, width - 2), joined[keep].reshape(n, width - 2)
            width -= 1
            for which, at in ((best > 0, best - 1), (best < width - 1, best)):
                r, c = each[which], at[which]
                rank[r, c], joined[r, c] = self._ranked(sym[r, c], sym[r, c + 1])

    def encode_chunks(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Ids of every chunk, held against the library's."""
        out: list[tuple[int, ...]] = [()] * len(chunks)
        by_length = defaultdict(list)
        for i, c in enumerate(chunks):
            by_length[len(c)].append(i)
        for length, places in by_length.items():
            if length > TOGETHER:
                for i in places:
                    out[i] = self.agenda(chunks[i])
            else:
                for k, ids in self._together([chunks[i] for i in places]):
                    out[places[k]] = ids
        # The library puts the prefix of a text before a chunk; a line end keeps it apart.
        bare = [c[1:] if c[0] == SPACE else "\n" + c for c in chunks]
        skip = len(self.library.encode("\n"))
        for c, mine, its in zip(chunks, out, self.library.encode(bare, num_threads=1)):
            if mine != tuple(its if c == SPACE and not its else its[0 if c[0] == SPACE else skip :]) and c != SPACE:
                raise RuntimeError(f"encoding differs from the library's: {c!r} {mine} {its}")
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: pieces joined, byte pieces read as UTF-8, the prefix taken off."""
        text = self.surface(ids)
        first = next((i for i in ids if i in self.of_byte or self.shown[i]), None)
        return text if first == self.unknown else text.removeprefix(" ")

    def surface(self, ids: Sequence[int]) -> str:
        """As ``decode``, with the prefix: surfaces of a text's chunks add up to the text's."""
        if self.of_byte.keys().isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        out: list[str] = []
        held = bytearray()

        def settle() -> None:
            at = 0
            while at < len(held):  # a byte that begins no character stands for itself
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + n].decode("utf-8"))
                        at += n
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            if i in self.of_byte:
                held.append(self.of_byte[i])
                continue
            if held:
                settle()
            out.append(self.shown[i])
        if held:
            settle()
        return "".join(out)


#: Ids with the end id, the same as decimal text, and the text decoded from them.
Coded = tuple[list[int], str, str]


class Coder:
    """Codes texts, and holds what it finds against the library."""

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        self.known: dict[str, tuple[int, ...]] = {}
        self.digits: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # what chunks decode to if not to themselves

    def __call__(self, texts: Iterable[str | None]) -> Iterator[Coded]:
        group: list[list[str]] = []
        chars = 0
        for text in texts:
            group.append(self.vocabulary.chunks(text or ""))
            chars += len(text or "")
            if chars > AT_ONCE:
                yield from self._group(group)
                group, chars = [], 0
        if group:
            yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[Coded]:
        if len(self.known) > REMEMBERED:
            for memory in (self.known, self.digits, self.odd):
                memory.clear()
        new = list(set(chain.from_iterable(group)) - self.known.keys())
        for c, ids in zip(new, self.vocabulary.encode_chunks(new)):
            self.known[c] = ids
            self.digits[c] = " ".join(map(str, ids))
            if (shown := self.vocabulary.surface(ids)) != c.replace(SPACE, " "):
                self.odd[c] = shown
        end, library = self.vocabulary.end, self.vocabulary.library
        found = [[*chain.from_iterable(map(self.known.__getitem__, c)), end] for c in group]
        for chunks, ids, its in zip(group, found, library.decode(found, num_threads=1)):
            shown = chunks if self.odd.keys().isdisjoint(chunks) else [self.odd.get(c, c) for c in chunks]
            mine = "".join(shown).replace(SPACE, " ").removeprefix(" ")
            if mine != its:
                raise RuntimeError(f"decoding differs from the library's: {mine[:80]!r} {its[:80]!r}")
            yield ids, " ".join([*map(self.digits.__getitem__, chunks), str(end)]), its


def _by_batch(model: bytes, batches: Iterator[pd.Series], use: Callable) -> Iterator[pd.DataFrame]:
    """``use`` of the coded texts of each batch, which come one group at a time."""
    gc.disable()  # nothing here makes cycles, and there are millions of small tuples
    try:
        coder = Coder(model)
        for texts in batches:
            yield use(coder(texts))
    finally:
        gc.enable()


def encoded(docs: DataFrame, model: bytes, keep: list[str], decoded: bool = True) -> DataFrame:
    """``keep`` columns, ``ids`` (with an end id), ``ids_sha256``, ``decoded_sha256`` and ``decoded``.

    ``decoded`` is left out if not asked for; the digests are of the ids as text and of what they decode
    to. A task holds the ids of ``SLICE`` characters of text at a time. Null and empty texts have
    the end id alone and decode to an empty text. Each row stands for itself, so repeated rows and
    ids are coded alike; an empty table gives no rows.
    """

    def start() -> Callable[..., list]:
        coder = Coder(model)

        def work(texts: list[str | None]) -> list:
            gc.disable()  # nothing here makes cycles, and there are millions of small tuples
            try:
                ends, flat, digits, shas, shown = [0], [], [], [], []
                for ids, as_text, text in coder(texts):
                    flat.append(np.array(ids, np.int32))
                    ends.append(ends[-1] + len(ids))
                    digits.append(_sha(as_text))
                    shas.append(_sha(text))
                    if decoded:
                        shown.append(text)
            finally:
                gc.enable()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, np.int32)])))
            return [lists, digits, shas, *([shown] if decoded else [])]

        return work

    add = "ids array<int>, ids_sha256 string, decoded_sha256 string" + (", decoded string" if decoded else "")
    return by_slices(docs, keep, add, start, at_once=SLICE)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digests(docs: DataFrame, model: bytes, keep: list[str]) -> DataFrame:
    """As ``encoded``, with counts and digests in place of ids and texts."""

    def use(coded: Iterator[Coded]) -> pd.DataFrame:
        rows = [(len(ids), _sha(digits), _sha(text)) for ids, digits, text in coded]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _by_batch(model, batches, use)

    udf = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(*keep, udf(F.col("text").cast("string")).alias("_coded")).select(*keep, "_coded.*")
