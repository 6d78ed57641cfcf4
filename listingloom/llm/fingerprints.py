"""Document fingerprints: threshold-scaled sketches of word shingles.

Of all shingle hashes a text has, those below a fixed fraction of the hash range are kept, and
the least one in any case. A sketch grows with its text, sketches of parts merge by union, and
the share of one sketch found in another estimates containment, however unequal the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingloom.llm.tables import SPACE, stored

SHINGLE = 5
#: One of so many shingle hashes is kept.
SCALE = 8
#: Documents in a range of ids that one task pairs up, roughly.
RANGE_ROWS = 4096
_LIMIT = np.uint64((1 << 64) // SCALE)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Sketcher:
    """Sketches of texts, with a bounded memory of word hashes."""

    def __init__(self, remembered: int = 300_000):
        self.word = re.compile(rf"[^{SPACE}]+")
        self.remembered = remembered
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if (h := self.known.get(word)) is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            h = self.known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def __call__(self, text: str) -> np.ndarray:
        """Sorted kept hashes; texts with fewer words than a shingle are one shingle, without words none."""
        words = self.word.findall(text)
        if not words:
            return np.zeros(0, np.uint64)
        each = np.fromiter(map(self._hash, words), np.uint64, len(words))
        n = min(SHINGLE, len(each))
        with np.errstate(over="ignore"):
            h = np.zeros(len(each) - n + 1, np.uint64)
            for k in range(n):
                h = h * _MIX + each[k : len(each) - n + 1 + k]
            h ^= h >> np.uint64(32)
            h *= _MIX
            h ^= h >> np.uint64(29)
        kept = h[h < _LIMIT]
        return np.unique(kept) if len(kept) else h.min(keepdims=True)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    kept = both[both < _LIMIT]
    return kept if len(kept) else both[:1]


def written(sketch: np.ndarray) -> str:
    """16 hex digits for each kept hash, ascending."""
    return sketch.astype(">u8").tobytes().hex()


def shared(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimated containment of the smaller text in the larger one, and resemblance."""
    if np.array_equal(a, b):
        return 1.0, 1.0
    if not len(a) or not len(b):
        return 0.0, 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / min(len(a), len(b)), both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """``text`` with its last half of code points replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` dealt into ranges of ids, each ending with the row that follows it.

    Ids are cut at quantiles; their number is that of the ranges. The first row of a range, in
    descending order, is also sent to the range before it, that of the topmost to the last.
    """
    rows = docs.count()
    spark = docs.sparkSession
    n = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
    cuts = docs.agg(
        F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("cuts")
    ).first()["cuts"]
    splits = [float("-inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    deal = Bucketizer(splits=splits, inputCol="_id", outputCol="_range", handleInvalid="keep")
    dealt = deal.transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
    ranges = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_range").cast("int"))
    dealt = dealt.select("doc_id", "text", ranges.alias("_range"))

    along = Window.orderBy(F.desc("_range"))  # a row per range
    heads = dealt.groupBy("_range").agg(F.max("doc_id").alias("_head"))
    last = Window.orderBy("_range")
    heads = heads.select(
        "_head", F.coalesce(F.lag("_range").over(along), F.first("_range").over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before")
    )
    heads = stored(heads, "heads")
    both = dealt.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    to = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("x")))).otherwise(
        F.array(
            F.struct(F.col("_range").alias("r"), F.lit(False).alias("x")),
            F.struct(F.col("_before").alias("r"), F.lit(True).alias("x")),
        )
    )
    return both.select("doc_id", "text", F.inline(to).alias("_to", "_extra"))


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    The next document is the one before it in order of id, the first follows the last; equal
    ids are ordered by text, nulls are last. Null texts are empty; an empty text's fingerprint
    is empty and like another empty one only. A table of one document follows itself; an empty
    table gives no rows. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _ranges(rows).repartition("_to").sortWithinPartitions("_to", "_extra", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "_to", "_extra")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = Sketcher()
        held = None  # the row whose next one is still to come
        for batch in batches:
            out = []
            for doc_id, text, to, extra in zip(batch["doc_id"], batch["text"], batch["_to"], batch["_extra"]):
                own = sketch(text)
                if held is not None and held[2] == to:
                    out.append(compare(sketch, held, text, own))
                held = None if extra else (doc_id, text, to, own)
            if out:
                yield pd.DataFrame(out, columns=names)

    def compare(sketch: Sketcher, row: tuple, following: str, next_sketch: np.ndarray) -> tuple:
        doc_id, text, _, own = row
        changed = edited(text, following)
        its = sketch(changed)
        near, alike = shared(own, its)
        near_next, alike_next = shared(own, next_sketch)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return (
            doc_id, len(text), sha, written(own), written(its),
            near, near_next, alike, alike_next,
        )

    schema = (
        "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, resembles_edited double, resembles_next double"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
