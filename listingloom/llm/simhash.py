"""SimHash near-duplicates: fingerprints, links at a small bit distance, groups.

Fingerprints of 64 bits are cut into two halves. Of two that differ in two bits at most, one
half differs in one bit at most, so they share a variant of that half with one bit left out.
Variants are equality-joined and the distance is verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingloom.llm.components import components
from listingloom.llm.tables import stored

SHINGLE = 3
MAX_BITS = 2
#: Variant groups above this many fingerprints are refined by variants of the other half.
PAIRED = 64
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of the word shingles of a text; 0 without words."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashed = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in shingles), dtype=np.uint64
    )
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 8192):  # bounds the unpacked bits of very long texts
        some = hashed[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashed)).view(">i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], name: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint ``name`` of every document; null texts count as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select(*keep, F.pandas_udf(run, "long")(F.col("text").cast("string")).alias(name))


def _half(fp: Column, seg: Column) -> Column:
    """High (seg 1) or low (seg 0) 32 bits."""
    high = F.shiftrightunsigned(fp, 32)
    return F.when(seg == 1, high).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def _without(value: Column, bit: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def variants(fps: DataFrame) -> DataFrame:
    """64 rows (fp, seg, bit, rest) of every fingerprint: a half with one bit left out."""
    grid = F.array(*(F.struct(F.lit(s).alias("seg"), F.lit(b).alias("bit")) for s in (0, 1) for b in range(32)))
    return fps.select("fp", F.inline(grid)).select(
        "fp", "seg", "bit", _without(_half(F.col("fp"), F.col("seg")), F.col("bit")).alias("rest")
    )


def _stars(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each fingerprint with the least one of its key; all that share the key are links."""
    least = rows.groupBy(*key).agg(F.min("fp").alias("v"), F.max("fp").alias("_top")).where("v < _top")
    return rows.join(least, key).where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that connect all ``fp`` at ``MAX_BITS`` bits or fewer.

    Small variant groups give every pair that verifies. In larger ones the other half's
    variants take part: who shares one bit left out on both sides, or equal halves and two
    bits left out on the other, is linked without comparing pairs, as no other bits can
    differ. A star to the least of them replaces the pairs; no link between components is lost.
    """
    key = ["seg", "bit", "rest"]
    group = Window.partitionBy(*key)
    hits = variants(fps.distinct()).withColumn("n", F.count("*").over(group)).where("n > 1")
    hits = stored(hits, "variants")

    few, many = hits.where(F.col("n") <= PAIRED), hits.where(F.col("n") > PAIRED)
    other = few.select(*key, F.col("fp").alias("v"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= MAX_BITS
    pairs = few.join(other, key).where((F.col("fp") < F.col("v")) & near)
    pairs = pairs.select(F.col("v").alias("u"), F.col("fp").alias("v"))

    rest = _half(F.col("fp"), 1 - F.col("seg"))
    bit = lambda n: F.sequence(F.lit(0), F.lit(n))
    one = many.withColumn("bit2", F.explode(bit(31))).withColumn("rest2", _without(rest, F.col("bit2")))
    two = (
        many.where("bit = 0")  # once for each half: equal halves share every variant
        .select("fp", "seg", _half(F.col("fp"), F.col("seg")).alias("same"))
        .withColumn("bit2", F.explode(bit(30)))
        .withColumn("bit3", F.explode(F.sequence(F.col("bit2") + 1, F.lit(31))))
        .withColumn("rest2", _without(_without(rest, F.col("bit2")), F.col("bit3")))
    )
    return pairs.unionByName(_stars(one, [*key, "bit2", "rest2"])).unionByName(
        _stars(two, ["seg", "same", "bit2", "bit3", "rest2"])
    )


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the least id reachable over links names a group.

    Copies meet in their fingerprint before anything is compared. Null and empty texts have
    fingerprint 0. A null id is never a group's name unless the group has no other: then null.
    Rows that repeat are returned as often as they come. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, ["doc_id"]), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(first.select("fp"))).withColumnRenamed("node", "fp")
    named = stored(first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents that name their group, with all columns of ``docs``.

    Rows without an id are kept, as no group can be named after them. Where an id repeats, one
    row of each fingerprint stays.
    """
    groups = simhash_groups(docs).where("doc_id is not null")
    ids = stored(
        groups.groupBy("doc_id").agg(
            F.count("*").alias("_rows"), F.max((F.col("doc_id") != F.col("component_id")).cast("int")).alias("_copy"),
            F.min((F.col("doc_id") != F.col("component_id")).cast("int")).alias("_all"),
        ).where("_copy = 1 or _rows > 1"),
        "copies",
    )
    plain = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = docs.join(ids.where("_rows > 1 and _all = 0").select("doc_id"), "doc_id", "left_semi")
    again = fingerprints(again, docs.columns, "_simhash").dropDuplicates(["doc_id", "_simhash"]).select(docs.columns)
    return plain.unionByName(again)
