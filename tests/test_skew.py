"""One key holding a third of all rows or more, with joins that cannot be broadcast."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from listingloom.operators import diff, replay, subscribing

LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@contextmanager
def large_joins(spark):
    for key, value in LARGE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in LARGE:
            spark.conf.unset(key)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def rows(spark):
    """60,000 rows over 3 runs; (summer, hot) has every second row."""
    n = F.col("n")
    return (
        spark.range(60_000, numPartitions=8)
        .withColumnRenamed("id", "n")
        .select(
            F.lit("summer").alias("category"),
            F.when(n % 2 == 0, "hot").otherwise(n.cast("string")).alias("id"),
            (n % 3 + 1).alias("run_no"),
            F.sha2(n.cast("string"), 512).alias("text"),
        )
    )


def test_new_listings_split_a_hot_id(spark, rows):
    seen = spark.createDataFrame([("summer", "1"), ("offseason", "hot")], "category string, id string")
    with large_joins(spark):
        fresh = diff.new_listings(rows, seen)
        fresh.write.format("noop").mode("overwrite").save()
        got = fresh.collect()
        assert "skew=true" in final_plan(fresh)
    assert len(got) == 59_999
    assert sum(r["id"] == "hot" for r in got) == 30_000


def test_replay_splits_a_hot_id(spark, rows):
    with large_joins(spark):
        fresh = replay.replay(rows)
        got = fresh.collect()
        assert "skew=true" in final_plan(fresh)
    # Odd ids are in one run each, hence new; the hot id is in all runs, new in the first.
    assert len(got) == 30_000 + 10_000
    assert {r["run_no"] for r in got if r["id"] == "hot"} == {1}


def test_fresh_keys_collapse_copies_before_the_shuffle(spark, rows):
    plan = replay.fresh_keys(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("collect_set") < plan.index("Exchange") < plan.rindex("partial_collect_set")
    assert plan.count("Exchange hashpartitioning") == 1


def test_admission_splits_a_hot_channel(spark):
    n = F.col("id")
    changes = spark.range(60_000, numPartitions=8).select(
        n.alias("seq"),
        F.when(n % 2 == 0, 7).otherwise(n).alias("guild_id"),
        F.sha2(n.cast("string"), 512).alias("category"),
        F.when(n % 2 == 0, 7).otherwise(n).alias("channel_id"),
    )
    facts = spark.range(60_000).select(
        n.alias("channel_id"),
        n.alias("owner_guild_id"),
        F.lit(True).alias("can_send"),
        (n % 5 != 1).alias("can_embed"),
    )
    with large_joins(spark):
        checked = subscribing.admit(changes, facts)
        refused = checked.filter(F.col("refusal").isNotNull())
        kept = checked.filter(F.col("refusal").isNull())
        got = kept.collect()
        assert "skew=true" in final_plan(kept)
        assert refused.count() == 6_000
    assert len(got) == 54_000
