"""Subscriptions that are cut into slices and joined by lists."""

from pyspark.sql import functions as F

from listingloom.operators import routing
from listingloom.schema import SUBSCRIPTION


def numbered_and_subscriptions(spark):
    numbered = spark.createDataFrame(
        [("summer", n, str(n % 30)) for n in range(1, 41)], "category string, position long, id string"
    )
    rows = [(g if g else None, "summer", 100 + g % 25, g) for g in range(30)] * 2 + [(None, "summer", None, 7)] * 9
    return numbered, spark.createDataFrame(rows, SUBSCRIPTION)


def sliced(numbered, subs):
    return routing.fan_out(numbered, subs, routing.Sizes(69, 40, 40 * 69), broadcast_rows=5, rows_per_task=100)


def test_neither_side_is_broadcast_or_shuffled_twice(spark):
    """The planner takes the copies of a side for one and would broadcast them."""
    numbered, subs = numbered_and_subscriptions(spark)
    out = sliced(numbered, subs).groupBy("position").agg(F.sum("channel_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("ENSURE_REQUIREMENTS") == 1


def test_lists_open_to_the_rows_of_a_broadcast(spark, monkeypatch):
    """Also where keys repeat or are null, and where the rows of a slice fill several lists."""
    monkeypatch.setattr(routing, "_LIST_BITS", 1)
    numbered, subs = numbered_and_subscriptions(spark)
    want = routing.fan_out(numbered, subs, routing.Sizes(69, 40, 40 * 69))
    got = sliced(numbered, subs)
    assert sorted(got.columns) == sorted(want.columns) and got.count() == 40 * 69
    assert got.select(want.columns).exceptAll(want).isEmpty()


def test_totals_of_listings_whose_id_repeats(spark):
    numbered, subs = numbered_and_subscriptions(spark)
    made = sliced(numbered, subs).withColumn("seq", F.col("position"))
    want = made.groupBy("category", "id").agg(F.count("*"), F.sum("channel_id"), F.sum("seq"))
    got = routing.totals_per_listing(made, numbered)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 30
