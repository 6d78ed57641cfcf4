"""Removal of every byte that a long repeated string covers, by bucket refinement.

Suffixes that begin with one q-gram share a bucket. Sorting all of a corpus would move every
byte, so only one suffix of each window of ``LENGTH`` bytes is put in: the one whose q-gram has
the least hash, which is the same wherever the window occurs. Buckets are refined by
identifiers of what stands at other offsets, first of the whole stretch of windows that one
suffix speaks for, then of blocks of them, then of single windows. Each refinement takes over
the identifiers of the one before: members whose identifier is shared are repeated and go on
as one, members of buckets with one identifier are settled, the rest are refined again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm.tables import maybe_in, stored

#: Bytes of a repeated string, of the q-gram that puts a suffix in its bucket.
LENGTH = 400
Q = 32
#: A window's q-gram lies 0 to FAR bytes into it; so many windows make a block.
FAR = LENGTH - Q
BLOCK = 24
_PART = 1 << 18
_INDEX = np.uint64((1 << 20) - 1)
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

#: A suffix and the offsets lo..hi before it at which the windows it speaks for begin.
PLACE = ["d1", "d2", "doc_id", "a", "lo", "hi"]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _id(data: memoryview, start: int, end: int, seed: int = 0) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data[start:end], seed=seed))


def suffixes(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(a, lo, hi): the windows from a - hi to a - lo have their least q-gram at a."""
    held = None  # a stretch that the next part may go on with
    for at in range(0, max(0, len(data) - LENGTH + 1), _PART):  # bounds memory on very long texts
        part = memoryview(data)[at : at + _PART + LENGTH - 1]
        n = len(part) - Q + 1
        word = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        with np.errstate(over="ignore"):
            h = sum(word[8 * k : 8 * k + n] * c for k, c in enumerate(_ODD))
            h ^= h >> np.uint64(32)
            h *= _ODD[1]
        h = (h & ~_INDEX) | np.arange(n, dtype=np.uint64)  # the first of equal ones is the least
        width = FAR + 1
        padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
        padded[:n] = h
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - width + 1
        least = (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & _INDEX).astype(np.int64)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        last = np.r_[first[1:], windows] - 1
        for a, start, end in zip((least[first] + at).tolist(), (first + at).tolist(), (last + at).tolist()):
            if held and held[0] == a:
                held = (a, held[1], end)
                continue
            if held:
                yield held[0], held[0] - held[2], held[0] - held[1]
            held = (a, start, end)
    if held:
        yield held[0], held[0] - held[2], held[0] - held[1]


def _bounds(n: int, a: int, k: int) -> tuple[int, int]:
    """Offsets of block k before a, as far as their windows lie in a text of n bytes."""
    return max(BLOCK * k, a - (n - LENGTH)), min(BLOCK * k + BLOCK - 1, FAR, a)


def stretches(data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(a, lo, hi, bucket, identifier): suffixes, their windows made up to whole blocks."""
    view = memoryview(data)
    for a, lo, hi in suffixes(data):
        lo, hi = _bounds(len(data), a, lo // BLOCK)[0], _bounds(len(data), a, hi // BLOCK)[1]
        yield a, lo, hi, _id(view, a, a + Q), _id(view, a - hi, a - lo + LENGTH, 1 + lo * 512 + hi)


def blocks(data: bytes, a: int, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, bucket, identifier) of each block: the bytes common to its windows, and all of them."""
    view = memoryview(data)
    for k in range(lo // BLOCK, hi // BLOCK + 1):
        first, last = _bounds(len(data), a, k)
        common = _id(view, a - BLOCK * k, a - min(BLOCK * k + BLOCK - 1, FAR) + LENGTH, 1 + k)
        yield first, last, common, _id(view, a - last, a - first + LENGTH, 1 + first * 512 + last)


def windows(data: bytes, a: int, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """(l, l, bucket, identifier) of each window."""
    view = memoryview(data)
    for off in range(lo, hi + 1):
        own = _id(view, a - off, a - off + LENGTH, 1 + off)
        yield off, off, own, own


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of (start, end) spans that touch or overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """Texts as bytes, known by 128 bits; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("text"), text).alias("d2"),
        F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("data"),
    )


def _with_places(docs: DataFrame, places: DataFrame, purpose: str) -> DataFrame:
    """The texts that ``places`` are in, one row for each, with the list of them."""
    keys = ["d1", "d2", "doc_id"]
    others = [c for c in places.columns if c not in keys]
    lists = stored(places.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("places")), purpose)
    texts = maybe_in(_texts(docs), "d1", lists)
    own = lists.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    return texts.join(own, same).select(*keys, "data", "places")


def _refined(docs: DataFrame, open_: DataFrame, split: Callable, purpose: str) -> DataFrame:
    """Rows of smaller places in ``open_`` with bucket, identifier and number of occurrences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d1, d2, doc_id, data, places in zip(*(batch[c] for c in ("d1", "d2", "doc_id", "data", "places"))):
                for p in places:
                    for lo, hi, bucket, ident in split(data, p["a"], p["lo"], p["hi"]):
                        out.append((d1, d2, doc_id, p["a"], lo, hi, bucket ^ p["bucket"], ident, p["n"]))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = [*PLACE, "bucket", "ident", "n"]
    schema = "d1 long, d2 long, doc_id string, a int, lo int, hi int, bucket long, ident long, n long"
    rows = _with_places(docs, open_, purpose).withColumn("doc_id", F.col("doc_id").cast("string"))
    return stored(rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long")), purpose)


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated members of ``rows``; one member per identifier of the buckets that have several."""
    classes = rows.groupBy("bucket", "ident").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in PLACE))
    classes = stored(classes, "classes")
    shared = classes.where("n > 1").select("bucket", "ident")
    several = classes.groupBy("bucket").agg(F.count("*").alias("_m")).where("_m > 1").select("bucket")
    return rows.join(shared, ["bucket", "ident"], "left_semi"), classes.join(several, "bucket", "left_semi")


def _start_end(rows: DataFrame) -> DataFrame:
    return rows.select(
        "d1", "d2", (F.col("a") - F.col("hi")).alias("start"), (F.col("a") - F.col("lo") + LENGTH).alias("end")
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``d1, d2, spans, n_removed``: maximal runs to be removed from each text that has any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d1, d2, doc_id, data in zip(*(batch[c] for c in ("d1", "d2", "doc_id", "data"))):
                out.extend((d1, d2, doc_id, *s) for s in stretches(data))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = [*PLACE, "bucket", "ident"]
    schema = "d1 long, d2 long, doc_id string, a int, lo int, hi int, bucket long, ident long"
    texts = _texts(docs).where(F.octet_length("data") >= LENGTH).withColumn("doc_id", F.col("doc_id").cast("string"))
    every = stored(texts.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long")), "suffixes")
    twice = every.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    twice = stored(twice, "twice")  # so that Spark can split the join of a large bucket
    # Copies of a text have the same suffixes: they meet here, before any bucket is looked at.
    rows = maybe_in(every, "bucket", twice).join(twice, "bucket", "left_semi").groupBy("d1", "d2", "a", "lo", "hi", "bucket", "ident").agg(
        F.count("*").alias("n"), F.first("doc_id").alias("doc_id")
    )
    first, open_ = _settle(stored(rows, "buckets"))
    level2 = _refined(docs, open_, blocks, "blocks")
    second, open_ = _settle(level2)
    level3 = _refined(docs, open_, windows, "windows")
    often = level3.groupBy("bucket", "ident").agg(F.sum("n").alias("_n")).where("_n > 1").select("bucket", "ident")
    often = stored(often, "often")
    third = maybe_in(level3.where("n = 1"), "bucket", often).join(often, ["bucket", "ident"], "left_semi")
    spans = _start_end(first).unionByName(_start_end(second.where("n = 1"))).unionByName(_start_end(third))
    lists = spans.groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def merge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = [merged([(s["start"], s["end"]) for s in spans]) for spans in batch]
            yield pd.DataFrame(
                {"starts": [[s for s, _ in r] for r in runs], "ends": [[e for _, e in r] for r in runs]}
            )

    done = lists.select("d1", "d2", F.pandas_udf(merge, "starts array<int>, ends array<int>")("spans").alias("m"))
    length = F.aggregate(F.zip_with("m.starts", "m.ends", lambda s, e: e - s), F.lit(0), lambda x, y: x + y)
    return done.select(
        "d1", "d2", F.col("m.starts").alias("starts"), F.col("m.ends").alias("ends"), length.cast("long").alias("n_removed")
    )


def _cut(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    kept = [data[e:s] for e, s in zip([0, *ends], [*starts, len(data)])]
    return b"".join(kept)


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, starts, ends, kept_sha256`` of every document.

    A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too, in the
    same text or another one, judged on the input. Null and empty texts have no bytes; rows
    that repeat are copies of each other, whatever their ids. Columns other than ``doc_id`` and
    ``text`` are not read. An empty table gives no rows.
    """
    spans = stored(repeated_spans(docs), "spans")
    own = _texts(docs).select(
        "d1", "d2", "doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha")
    )
    own = stored(own, "texts")
    # Texts that lose a part are read once each, whatever number of copies there are.
    part = spans.join(own.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes")), ["d1", "d2"])
    part = part.where("n_removed < n_bytes").select("d1", "d2", "doc_id", "starts", "ends")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "d1": batch["d1"],
                    "d2": batch["d2"],
                    "kept": [
                        hashlib.sha256(_cut(data, list(p[0]["starts"]), list(p[0]["ends"]))).hexdigest()
                        for data, p in zip(batch["data"], batch["places"])
                    ],
                }
            )

    kept = _with_places(docs, part, "parts").select("d1", "d2", "data", "places").mapInPandas(run, "d1 long, d2 long, kept string")
    kept = kept.dropDuplicates(["d1", "d2"])
    all_ = spans.join(kept, ["d1", "d2"], "left")
    sha = F.when(F.col("n_removed").isNull(), F.col("sha")).when(
        F.col("n_removed") == F.col("n_bytes"), hashlib.sha256(b"").hexdigest()
    ).otherwise(F.col("kept"))
    return own.join(all_, ["d1", "d2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_spans"), "starts", "ends", sha.alias("kept_sha256"),
    )
