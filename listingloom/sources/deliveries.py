"""The log of delivery attempts, written by whoever drains an outbox.

A delivery is known by its run, channel and place in the channel; ``attempt`` orders the
attempts at it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPT = (
    "run_no bigint, channel_id bigint, seq bigint, attempt int, category string, id string, "
    "status string"
)


def record_attempts(attempts: DataFrame, path: str) -> None:
    """Adds attempts with status ``sent`` or ``failed``."""
    attempts.selectExpr(*(c.split()[0] for c in ATTEMPT.split(", "))).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The outcome of every delivery: its last attempt, as ``ATTEMPT``."""
    try:
        rows = spark.read.schema(ATTEMPT).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], ATTEMPT)
        raise
    last = [F.max_by(c, "attempt").alias(c) for c in ("category", "id", "status")]
    keyed = rows.groupBy("run_no", "channel_id", "seq").agg(F.max("attempt").alias("attempt"), *last)
    return keyed.select(rows.columns)
