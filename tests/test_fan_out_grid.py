from pyspark.sql import functions as F

from listingloom.operators import routing
from listingloom.schema import SUBSCRIPTION


def test_blocks_end_at_a_number_and_move_both_sides_alike():
    """Sizes carried on from sf0.01 to 1 GB: slices of 200 would copy every listing 6,350 times."""
    size = routing.Sizes(subscriptions=1_270_000, listings=54_600, deliveries=35 * 10**9)
    slices, shares = routing.grid(size, routing.MOST_TASKS)
    assert routing.MOST_TASKS <= slices * shares < routing.MOST_TASKS + slices
    by_listings, by_subscriptions = size.listings * slices, size.subscriptions * shares
    assert max(by_listings, by_subscriptions) < 2 * min(by_listings, by_subscriptions)
    assert routing.grid(routing.Sizes(3 * routing.BROADCAST_ROWS, 0, 0), 1) == (3, 1)


def test_tasks_of_a_large_fan_out_are_bounded(spark):
    numbered = spark.range(1, 41).select(
        F.lit("summer").alias("category"), F.col("id").alias("position"), F.col("id").cast("string")
    )
    subs = spark.createDataFrame([(g, "summer", 100 + g, g) for g in range(30)], SUBSCRIPTION)
    counts = spark.createDataFrame([("summer", 40), ("offseason", 0)], "category string, new_count long")
    assert routing.sizes(subs, counts) == routing.Sizes(30, 40, 1200)
    out = routing.fan_out(numbered, subs, routing.Sizes(30, 40, 10**10), broadcast_rows=5, rows_per_task=100)
    assert out.rdd.getNumPartitions() <= 4 * routing.MOST_TASKS
    assert out.select("guild_id", "id").distinct().count() == out.count() == 1200
