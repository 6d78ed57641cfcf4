"""Periodic runs of words, by branching tandem repeats in an enhanced suffix array.

A run of period q ends in a square (a stretch of q words, twice) after which the period breaks
off: the suffixes at the square's two halves share exactly q words. So squares are looked for
where the array of common prefixes (LCP) has its minima: each one parts the suffixes before it
from those after it, which share as many words as it says. Of the smaller side every suffix i is
asked whether the suffix at i + depth, or at i - depth, is on the other side, by its place in the
array (ISA). No nodes of a tree are made. A square found is rotated to the left while its words
allow it, which gives the whole run; squares of multiples of a run's period, which end where it
ends, merge into it.

Suffix arrays are made of several documents at a time, held apart by words that occur once, and
only of documents in which any run can be: those where a stretch of words occurs twice that is as
long as the least overlap of a run with itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.tables import by_slices, shuffled64

#: Words and periods that a run has at least.
MIN_LENGTH = 24
MIN_PERIODS = 3
#: Pairs of suffix and minimum that are looked at together.
_TOGETHER = 4_000_000

#: (first word, number of words, period)
Run = tuple[int, int, int]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all documents, each with a number of its own after it; where each begins."""
    top = max((int(d.max()) for d in docs if len(d)), default=0) + 1
    parts: list[np.ndarray] = []
    for k, d in enumerate(docs):
        parts += [d, np.array([top + k], np.int64)]
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])[:-1]
    return np.concatenate(parts), starts


def may_have_runs(docs: list[np.ndarray], least: int) -> list[int]:
    """Which documents have a stretch of ``least`` words, or nearly as many, in two places.

    Found by hashes, so a few may be named that have none; none is passed over.
    """
    seq, starts = _joined(docs)
    n, width = len(seq), 1
    h = shuffled64(seq.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        while 2 * width <= least:  # a power of two does: it is no longer than the stretch
            h = shuffled64(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]) if len(h) > width else h[:0]
            width *= 2
        whose = np.searchsorted(starts, np.arange(len(h)), "right") - 1
        h = h ^ shuffled64(whose.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    low = np.uint64((1 << n.bit_length()) - 1)
    keys = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    same = np.flatnonzero((keys[1:] & ~low) == (keys[:-1] & ~low))
    return np.unique(whose[(keys[same] & low).astype(np.int64)]).tolist() if len(same) else []


def suffix_array(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, the place of each, and words shared with the one before (-1 at first).

    By prefix doubling. ``seq`` must end with a number that occurs once.
    """
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, in_order[1:] != in_order[:-1]])
        ranks.append(rank.astype(np.int32))
        width *= 2
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        more = (ranks[level][a] == ranks[level][b]).astype(np.int64) << level
        a, b = a + more, b + more
        shared[1:] += more
    shared[0] = -1
    return order, rank, shared


def _sides(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place k: where the suffixes begin that it parts from its own, and where its own end.

    These are the last place before k with a lesser value, and the first after it with none greater.
    """
    values = shared.tolist()
    left, right = [0] * len(values), [len(values)] * len(values)
    open_: list[int] = []
    for k, v in enumerate(values):
        while open_ and values[open_[-1]] >= v:
            right[open_.pop()] = k
        left[k] = open_[-1] if open_ else 0
        open_.append(k)
    return np.array(left), np.array(right)


def branching_squares(seq: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods, up to ``longest``, of all squares that the word after them breaks off."""
    order, place, shared = suffix_array(seq)
    left, right = _sides(shared)
    k = np.flatnonzero((shared >= 1) & (shared <= longest))
    depth, before, after = shared[k], k - left[k], right[k] - k
    less = before <= after
    first, count = np.where(less, left[k], k), np.where(less, before, after)
    low, high = np.where(less, k, left[k]), np.where(less, right[k], k)  # the other side
    starts: list[np.ndarray] = [np.zeros(0, np.int64)]
    periods: list[np.ndarray] = [np.zeros(0, np.int64)]
    total = np.cumsum(count)
    at = 0
    while at < len(k):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _TOGETHER, "right")))
        c = count[at:end]
        own = np.repeat(np.arange(at, end), c)
        i = order[np.arange(len(own)) - np.repeat(np.cumsum(c) - c, c) + first[own]]
        for sign in (1, -1):
            j = i + sign * depth[own]
            inside = (j >= 0) & (j < len(seq))
            p = place[np.where(inside, j, 0)]
            hit = inside & (p >= low[own]) & (p < high[own])
            starts.append(np.minimum(i, j)[hit])
            periods.append(depth[own][hit])
        at = end
    return np.concatenate(starts), np.concatenate(periods)


def _rotated(seq: np.ndarray, start: int, period: int) -> int:
    """Where the period that holds from ``start`` on begins."""
    step = 32
    while start > 0:
        n = min(step, start)
        differ = np.flatnonzero(seq[start - n : start] != seq[start - n + period : start + period])
        if len(differ):
            return start - n + int(differ[-1]) + 1
        start -= n
        step *= 4
    return start


def least_overlap(min_length: int, min_periods: int) -> int:
    """Words that a run shares with itself one period further on, at least."""
    return min(max(min_length - q, (min_periods - 1) * q) for q in range(1, min_length + 1))


def find_runs(docs: list[np.ndarray], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[Run]]:
    """The runs of each document (numbers in place of words), by start, then period."""
    found: list[list[Run]] = [[] for _ in docs]
    chosen = may_have_runs(docs, least_overlap(min_length, min_periods)) if docs else []
    if not chosen:
        return found
    seq, begins = _joined([docs[k] for k in chosen])
    t, d = branching_squares(seq, max(len(docs[k]) for k in chosen) // min_periods)
    need = np.maximum(min_length - 2 * d, (min_periods - 2) * d)  # words to the left of the square
    for j in range(1, 9):  # most squares of texts go no further
        back = t - j
        go = (need < j) | ((back >= 0) & (seq[np.maximum(back, 0)] == seq[np.maximum(back + d, 0)]))
        t, d, need = t[go], d[go], need[go]
    known: list[tuple[int, int]] = []  # periods of the runs that end here, and where they begin
    last = -1
    order = np.lexsort((d, t + 2 * d))
    for start, period in zip(t[order].tolist(), d[order].tolist()):
        end = start + 2 * period
        if end != last:
            known, last = [], end
        if any(period % q == 0 and end - s >= 2 * period for q, s in known):
            continue
        start = _rotated(seq, start, period)
        if end - start >= max(min_length, min_periods * period):
            known.append((period, start))
            k = int(np.searchsorted(begins, start, "right")) - 1
            found[chosen[k]].append((start - int(begins[k]), end - start, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


#: Given the words of a document and the value of another column, the words to look at.
Rewrite = Callable[[list[bytes], object], list[bytes]]


def periodic_runs(
    docs: DataFrame, keep: list[str], rewrite: tuple[str, Rewrite] | None = None,
    min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS,
) -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` (by start, then period) and the ``collapsed`` text.

    Words are what ASCII white space parts. A run is a stretch with smallest period q of at least
    ``min_length`` words and ``min_periods`` periods that neither neighbour continues. In the
    collapsed text its words after the first q are left out; words are joined by one space.
    ``rewrite`` names a column and a function of the words and that column's value, whose result
    is looked at in place of the words. Null, empty and white texts have no words, no runs and an
    empty collapsed text. Each row stands for itself, so repeated rows and ids give equal results;
    an empty table gives no rows. Other columns, whatever their names, are not read.
    """

    def start() -> Callable[..., list]:
        def work(texts: list[str | None], values: list | None = None) -> list:
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
            if rewrite:
                words = [rewrite[1](w, v) for w, v in zip(words, values)]
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            runs = find_runs(
                [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words], min_length, min_periods
            )
            left = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, runs)]
            flat = np.array([r for some in runs for r in some], np.int64).reshape(-1, 3)
            ends = np.cumsum([0, *map(len, runs)])
            listed = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()),
                pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names=["start", "length", "period"]),
            )
            return [[len(w) for w in words], listed, left]

        return work

    reads = ["text", rewrite[0]] if rewrite else ["text"]
    return by_slices(docs, keep, f"n_words bigint, runs {RUNS}, collapsed string", start, reads)


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period; of equal ones that with the least start, then period."""

    def order(a: Column, b: Column) -> Column:
        more, less = a["length"] * b["period"], b["length"] * a["period"]
        first = (more > less) | (
            (more == less) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])))
        )
        return F.when(first, -1).when(a.eqNullSafe(b), 0).otherwise(1)

    return F.get(F.array_sort(runs, order), F.lit(0))


def as_lines(runs: Column) -> Column:
    """``start,length,period`` of every run, each on a line of its own."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
