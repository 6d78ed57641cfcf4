"""Counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.functions.season import category
from listingloom.operators.select import is_postable, is_since
from listingloom.schema import CATEGORIES, OFFSEASON, SUMMER


def counter_columns(start: int | None, accepted: Column | None = None) -> list[Column]:
    """Counters as plain aggregates, usable in ``agg`` and in ``observe``.

    ``accepted`` marks the rows that passed validation; without it all did.
    """
    accepted = F.lit(True) if accepted is None else accepted
    postable = accepted & is_postable()
    found = F.when(postable & is_since(start), category(F.col("terms")))
    return [
        F.count_if(accepted).alias("processed"),
        F.count_if(postable & ~is_since(start)).alias("filtered"),
        F.count_if(found == SUMMER).alias("summer_found"),
        F.count_if(found == OFFSEASON).alias("offseason_found"),
        F.count_if(~accepted).alias("rejected"),
    ]


def scrape_counters(
    listings: DataFrame, start: int | None, accepted: Column | None = None
) -> DataFrame:
    """One row: processed, filtered, found per category, rejected. One pass, no shuffle."""
    return listings.agg(*counter_columns(start, accepted))


def new_counts(new: DataFrame) -> DataFrame:
    """``category, new_count`` for both categories, zero included."""
    totals = new.agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("category"), F.col(c).alias("new_count"))
                    for c in CATEGORIES
                ]
            )
        )
    )


def total_new(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("new_count").alias("total_new"))


STATISTICS = (
    "processed bigint, filtered bigint, summer_found bigint, offseason_found bigint, "
    "rejected bigint, summer_new bigint, offseason_new bigint, total_new bigint, deliveries bigint"
)


def run_statistics(found: DataFrame, counts: DataFrame, deliveries: int) -> DataFrame:
    """One row as ``STATISTICS``, of the counters and the new counts of a run."""

    def new(category: str):
        return counts.agg(F.sum(F.when(F.col("category") == category, F.col("new_count")))).scalar()

    return found.select(
        "*",
        new(SUMMER).alias("summer_new"),
        new(OFFSEASON).alias("offseason_new"),
        total_new(counts).scalar().alias("total_new"),
        F.lit(deliveries).cast("bigint").alias("deliveries"),
    )


def delivery_stats(log: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: posted per category, errors of both, and the count of new listings.

    ``log`` has one row per attempt: ``category, status`` (``sent`` or ``failed``).
    Channels that were skipped have no attempt and count nowhere.
    """
    sent = F.col("status") == "sent"
    return log.agg(
        F.count_if(sent & (F.col("category") == SUMMER)).alias("summer_posted"),
        F.count_if(sent & (F.col("category") == OFFSEASON)).alias("offseason_posted"),
        F.count_if(F.col("status") == "failed").alias("errors"),
    ).select("*", total_new(counts).scalar().alias("total_new"))
