"""The log of settings: scrape interval and start date, as they last over restarts.

Changes are only ever added. ``seq`` orders them; of each setting the last accepted value counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.schema import DEFAULT_INTERVAL_HOURS, INTERVAL_HOURS_RANGE
from listingloom.sources.params import RunParams, run_params

CHANGE = "seq bigint, scrape_interval_hours double, scrape_start_timestamp bigint"


def refusal() -> Column:
    """Why a change may not be stored; null when it may. A null setting is left as it was."""
    low, high = INTERVAL_HOURS_RANGE
    hours, start = F.col("scrape_interval_hours"), F.col("scrape_start_timestamp")
    return (
        F.when(hours.isNotNull() & ~hours.between(low, high), "bad_interval")
        .when(start <= 0, "bad_start")
        .when(hours.isNull() & start.isNull(), "nothing_set")
    )


def record_settings(changes: DataFrame, path: str) -> DataFrame:
    """Stores the accepted changes and returns the refused ones with their reason."""
    checked = changes.withColumn("refusal", refusal())
    accepted = checked.filter(F.col("refusal").isNull()).drop("refusal")
    accepted.write.mode("append").parquet(path)
    return checked.filter(F.col("refusal").isNotNull())


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row: interval, or its default, and start date, null if none was ever set."""
    try:
        rows = spark.read.schema(CHANGE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CHANGE)

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq")))

    return rows.agg(
        F.coalesce(last("scrape_interval_hours"), F.lit(DEFAULT_INTERVAL_HOURS)).alias("scrape_interval_hours"),
        last("scrape_start_timestamp").alias("scrape_start_timestamp"),
    )


def stored_params(spark: SparkSession, path: str, as_of: int) -> RunParams:
    """Parameters of a run at ``as_of`` under the stored settings."""
    row = read_settings(spark, path).first()
    return run_params(
        as_of, start=row["scrape_start_timestamp"], interval_hours=row["scrape_interval_hours"]
    )
