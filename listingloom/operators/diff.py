"""What is new against the ids seen in the previous run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["category", "id"]


def new_listings(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Listings whose (category, id) is not in ``seen``.

    A key join, not a set difference: copies of an id within a snapshot all
    survive, and an id that changed category is new again.
    """
    return current.join(seen.select(*KEY), KEY, "left_anti")


def new_listings_narrow(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Same rows as :func:`new_listings`, for wide stored snapshots.

    Only keys are shuffled against the seen set. The new keys, few in a feed that
    mostly repeats itself, then pick the full rows in a second, stored scan;
    Catalyst broadcasts them when they turn out small enough.
    """
    fresh = all_ids(current).join(seen.select(*KEY), KEY, "left_anti")
    return current.join(fresh, KEY, "left_semi")


def all_ids(current: DataFrame, category: str | None = None) -> DataFrame:
    """Distinct (category, id); empty for a category that does not exist."""
    rows = current if category is None else current.filter(F.col("category") == category)
    return rows.select(*KEY).distinct()
