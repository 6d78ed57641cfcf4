"""Filters, ordering and top-k over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listingloom.functions.season import category, category_rank
from listingloom.schema import PREVIEW_SIZE


def is_postable() -> Column:
    return F.col("active") & F.col("is_visible")


def is_since(start: int | None) -> Column:
    """``date_posted >= start``; no start, or start zero, lets everything pass."""
    return F.col("date_posted") >= F.lit(start) if start else F.lit(True)


def postable(listings: DataFrame) -> DataFrame:
    return listings.filter(is_postable())


def since(listings: DataFrame, start: int | None) -> DataFrame:
    return listings.filter(is_since(start))


def categorised(listings: DataFrame) -> DataFrame:
    """Adds ``category``; listings without a season are dropped."""
    return listings.withColumn("category", category(F.col("terms"))).filter(
        F.col("category").isNotNull()
    )


def current(listings: DataFrame, start: int | None) -> DataFrame:
    """What a run looks at: postable, recent enough and of a known season."""
    return categorised(since(postable(listings), start))


def tie(listings: DataFrame) -> str:
    """Equal dates keep the feed's order; ids decide where no order is known."""
    return "ordinal" if "ordinal" in listings.columns else "id"


def newest_first_keys(listings: DataFrame) -> list[Column]:
    return [category_rank(F.col("category")), F.col("date_posted").desc(), F.col(tie(listings))]


def newest_first(listings: DataFrame) -> DataFrame:
    """One range-partitioned sort: two categories must not mean two tasks."""
    return listings.orderBy(*newest_first_keys(listings))


def latest_per_category(listings: DataFrame, k: int = PREVIEW_SIZE) -> DataFrame:
    """The ``k`` newest of each category, as ``position`` 1..k.

    Every task keeps at most ``k`` rows per category before the shuffle.
    """
    newest = Window.partitionBy("category").orderBy(
        F.col("date_posted").desc(), F.col(tie(listings))
    )
    return listings.withColumn("position", F.row_number().over(newest).cast("bigint")).filter(
        F.col("position") <= k
    )
