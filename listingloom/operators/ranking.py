"""Dense positions over a global order without gathering a category in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listingloom.operators.select import newest_first_keys

# monotonically_increasing_id: partition number above, row number in the lower 33 bits.
_ROW_BITS = 33


def store_in_order(rows: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Writes the rows, globally sorted, with ``slot``: their place in their partition.

    ``order`` must sort by category first. A row_number window would put a whole
    category in one task; a sort is range-partitioned. Writing the rows fixes the
    partition bounds, so that a lost executor cannot move them before
    :func:`with_positions` has counted the rows of each partition.
    """
    sorted_rows = rows.orderBy(*order).withColumn("slot", F.monotonically_increasing_id())
    sorted_rows.write.mode("overwrite").parquet(into)
    return rows.sparkSession.read.schema(sorted_rows.schema).parquet(into)


def with_positions(stored: DataFrame, name: str = "position") -> DataFrame:
    """Turns ``slot`` into ``name``: 1, 2, 3, ... within a category, in stored order.

    Needs only a small table of rows per (category, partition).
    """
    stored = stored.withColumn("part", F.shiftright("slot", _ROW_BITS))
    parts = stored.groupBy("category", "part").agg(
        F.count("*").alias("part_rows"), F.min("slot").alias("first_slot")
    )
    before = (
        Window.partitionBy("category").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = parts.select(
        "category",
        "part",
        (F.coalesce(F.sum("part_rows").over(before), F.lit(0)) - F.col("first_slot") + 1).alias(
            "shift"
        ),
    )
    # Two categories: never more than two rows per partition of the sort.
    return (
        stored.join(F.broadcast(shifts), ["category", "part"])
        .withColumn(name, F.col("slot") + F.col("shift"))
        .drop("slot", "part", "shift")
    )


def store_newest_first(listings: DataFrame, into: str) -> DataFrame:
    return store_in_order(listings, newest_first_keys(listings), into)
