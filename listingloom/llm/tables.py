"""What the operators share: inputs, words, and tables cut off from their lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from listingloom.session import scratch

# What separates words, as a character class for Java, Python and RE2.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    The copy survives lost executors, is computed once however often it is used, and has a
    size the planner knows.
    """
    spark = df.sparkSession
    path = scratch(spark, purpose)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a filter by which rows without a part in a join stay where they are. It has this
#: size whatever the input; where it fills up more rows are moved, none is missed.
FILTER_BITS = 1 << 24


def _bit(key: Column) -> Column:
    return key.bitwiseAND(F.lit(FILTER_BITS - 1))


def bit_map(keys: DataFrame, key: str) -> DataFrame:
    """One row ``bits``: the hashes ``key`` as a bit map, an array of words."""
    at = _bit(F.col(key))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    every = keys.sparkSession.range(FILTER_BITS // 64).withColumnRenamed("id", "word")
    row = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.join(words, "word", "left").agg(F.transform(row, lambda s: s["bits"]).alias("bits"))


def maybe_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose hash ``key`` isn't among ``keys``; a join must follow."""
    bits = stored(bit_map(keys, key), "bits")
    at = _bit(F.col(key))
    word = F.get("_bits", F.shiftright(at, 6).cast("int"))
    hit = F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn("_bits", bits.scalar()).where(hit).drop("_bits")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array, in order."""
    return F.array_remove(F.split(text, rf"[{SPACE}]+"), "")


#: Characters of texts that a Python worker looks at together.
AT_ONCE = 1_000_000


def by_slices(
    docs: DataFrame, keep: list[str], add: str, work: Callable[[], Callable[..., list]], reads: Sequence[str] = ("text",),
    at_once: int = AT_ONCE,
) -> DataFrame:
    """``keep`` columns as they are, and the columns ``add`` (as DDL) that Python makes of each row.

    ``work()`` is called once in each task; what it returns is called with a list of texts (null:
    ``None``), and one of values for each further column of ``reads``, of rows that have at most
    ``at_once`` characters together or are one row. It returns the added columns, lists or Arrow
    arrays of as many values. So a worker holds one such slice beside Spark's own batch.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + T.StructType.fromDDL(add).fields)
    kinds = [f.type for f in to_arrow_schema(schema)]
    own = [F.col(c).cast("string" if i == 0 else docs.schema[c].dataType).alias(f"_read{i}") for i, c in enumerate(reads)]
    rows = docs.select(*(F.col(c) for c in keep), *own)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work()
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(n)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + at_once, "right")))
                some = batch.slice(at, end - at)
                found = made(*(some.column(n + i).to_pylist() for i in range(len(reads))))
                new = [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(found, kinds[n:], strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[:n], *new], names=schema.names)
                at = end

    return rows.mapInArrow(run, schema)


def shuffled64(x: np.ndarray) -> np.ndarray:
    """A mix of the bits of unsigned 64-bit numbers, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
