"""The log of channel changes, the stored form of all subscriptions.

Changes are only ever added; ``seq`` orders them and is given by whoever records them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.operators import subscribing

CHANGE = "seq bigint, guild_id bigint, category string, channel_id bigint"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """All stored changes; none before the first was recorded."""
    try:
        return spark.read.schema(CHANGE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], CHANGE)
        raise


def record_changes(changes: DataFrame, channel_facts: DataFrame, path: str) -> DataFrame:
    """Stores the admitted changes and returns the refused ones with their reason."""
    checked = subscribing.admit(changes, channel_facts)
    admitted = checked.filter(F.col("refusal").isNull())
    admitted.select("seq", "guild_id", "category", "channel_id").write.mode("append").parquet(path)
    return checked.filter(F.col("refusal").isNotNull())


def read_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    return subscribing.subscriptions(subscribing.guild_settings(read_changes(spark, path)))
