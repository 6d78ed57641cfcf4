"""New listings of every run of a history at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["category", "id"]


def fresh_keys(rows: DataFrame) -> DataFrame:
    """(category, id, run_no) where the key was not in run ``run_no - 1``.

    A key's runs are collected as a set: copies collapse before the one shuffle,
    and a key never holds more than the number of runs. ``run_no`` counts executed
    runs without gaps; a run with an empty snapshot keeps its number.
    """
    runs = F.array_sort(F.collect_set("run_no"))
    first_of_stretch = F.filter(
        F.col("runs"), lambda n, i: (i == 0) | (F.get(F.col("runs"), i - 1) < n - 1)
    )
    return (
        rows.groupBy(*KEY)
        .agg(runs.alias("runs"))
        .select(*KEY, F.explode(first_of_stretch).alias("run_no"))
    )


def replay(rows: DataFrame) -> DataFrame:
    """The rows, copies included, that were new in their run."""
    return rows.join(fresh_keys(rows), [*KEY, "run_no"], "left_semi")


def replay_after(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """As :func:`replay` for a stretch of history that follows a stored seen set.

    ``run_no`` counts the runs of the stretch from 1; ``seen``, distinct (category, id), is what the
    run before them left and stands as run 0. Copies within ``seen`` and ``rows`` do no harm.
    """
    keys = rows.select(*KEY, "run_no")
    before = seen.select(*KEY, F.lit(0).cast(rows.schema["run_no"].dataType).alias("run_no"))
    fresh = fresh_keys(keys.unionAll(before)).filter("run_no > 0")
    return rows.join(fresh, [*KEY, "run_no"], "left_semi")
