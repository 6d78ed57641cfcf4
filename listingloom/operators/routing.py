"""From new listings to deliveries: live channels, fan-out, delivery order."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listingloom.functions.season import category_rank

# Subscription rows are four short columns: this many stay far below 100 MB.
BROADCAST_ROWS = 500_000
# Deliveries that one task makes, roughly, as long as that takes no more than MOST_TASKS tasks.
ROWS_PER_TASK = 1_000_000
MOST_TASKS = 1_000
# Subscriptions of a slice are held in lists of up to two to the power of this.
_LIST_BITS = 12


def live_subscriptions(subscriptions: DataFrame, live_channels: DataFrame) -> DataFrame:
    """Subscriptions whose channel can be reached; the others are skipped silently."""
    return subscriptions.join(live_channels.select("channel_id"), "channel_id", "left_semi")


@dataclass(frozen=True)
class Sizes:
    """How much a fan-out takes in and makes, by counts per category."""

    subscriptions: int
    listings: int
    deliveries: int


def sizes(subscriptions: DataFrame, counts: DataFrame) -> Sizes:
    per = subscriptions.groupBy("category").agg(F.count("*").alias("n"))
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    made = per.join(F.broadcast(counts), "category", "left").agg(
        total("n"), total("new_count"), total(F.col("n") * F.col("new_count"))
    )
    return Sizes(*made.first())


def grid(size: Sizes, tasks: int) -> tuple[int, int]:
    """Slices of the subscriptions and shares of the listings: about ``tasks`` blocks in all.

    Each listing is moved once per slice and each subscription once per share, so the blocks are
    cut where both sides move about as many rows. A slice holds ``BROADCAST_ROWS`` at most.
    """
    least = -(-size.subscriptions // BROADCAST_ROWS)
    balanced = math.isqrt(tasks * size.subscriptions // max(size.listings, 1))
    slices = max(1, least, min(balanced, tasks, size.subscriptions))
    return slices, max(1, -(-tasks // slices))


def fan_out(
    numbered: DataFrame,
    subscriptions: DataFrame,
    size: Sizes,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every new listing to every subscription of its category.

    ``numbered`` carries ``position``. There are only two join keys, so a plain shuffle would
    use two tasks, and a plain broadcast as many as the few listings have splits. The number
    of tasks follows from the rows to be made instead: listings are dealt out by position.
    Up to ``broadcast_rows`` subscriptions are broadcast; beyond that they are cut into slices,
    and every (category, slice, share of the listings) is a join key of its own. Deliveries grow
    with the product of both sides, so the number of tasks ends at ``MOST_TASKS``.
    """
    wanted = [c for c in ("guild_id", "category", "channel_id", "guild_order", "seq_before") if c in subscriptions.columns]
    subscriptions = subscriptions.select(wanted)
    tasks = min(max(1, -(-size.deliveries // rows_per_task)), MOST_TASKS)
    if size.subscriptions <= broadcast_rows:
        dealt = numbered.repartition(tasks, "position") if tasks > 1 else numbered
        return dealt.join(F.broadcast(subscriptions), "category")

    slices, shares = grid(size, tasks)
    # Both sides number slices and shares by int: keys of unlike types are shuffled once more to be joined.
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda key, n: F.pmod(key, F.lit(n)).cast("int")
    cut = subscriptions.withColumn("slice", place(F.xxhash64("guild_id", "channel_id"), slices)).withColumn(
        "share", numbers(shares)
    )
    spread = numbered.withColumn("share", place(F.col("position"), shares)).withColumn("slice", numbers(slices))
    keys, parts = ["category", "slice", "share"], 2 * slices * shares
    # Subscriptions are joined by lists, which are opened afterwards: a delivery costs no look-up of its own.
    # The list's number only bounds its length; rows of a key stay in the task that the key belongs to.
    held = (
        cut.repartition(parts, *keys)
        .withColumn("list", F.shiftright(F.monotonically_increasing_id(), _LIST_BITS))
        .groupBy(*keys, "list")
        .agg(F.collect_list(F.struct(*[c for c in wanted if c != "category"])).alias("held"))
    )
    # The planner takes either side for one copy of its rows: without a hint it sends all copies to the driver.
    joined = spread.repartition(parts, *keys).join(held.hint("merge"), keys)
    return joined.select("category", *[c for c in numbered.columns if c != "category"], F.inline("held"))


def delivery_starts(subscriptions: DataFrame, counts: DataFrame) -> DataFrame:
    """``seq_before``: what a channel has received before this subscription begins.

    A channel gets summer before offseason and guilds in stored order. Each
    subscription delivers exactly its category's new listings, so the running
    total needs the counts alone, not the deliveries.
    """
    earlier = (
        Window.partitionBy("channel_id")
        .orderBy(category_rank(F.col("category")), "guild_order", "guild_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sized = subscriptions.join(F.broadcast(counts), "category")
    return sized.withColumn(
        "seq_before", F.coalesce(F.sum("new_count").over(earlier), F.lit(0))
    ).drop("new_count")


def deliveries(
    numbered: DataFrame,
    subscriptions: DataFrame,
    counts: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
    size: Sizes | None = None,
) -> DataFrame:
    """Fan-out with ``seq``, the place of a delivery in its channel.

    ``counts`` has one row per category: ``category, new_count``.
    """
    starts = delivery_starts(subscriptions, counts)
    return (
        fan_out(numbered, starts, size or sizes(subscriptions, counts), broadcast_rows, rows_per_task)
        .withColumn("seq", F.col("seq_before") + F.col("position"))
        .drop("seq_before")
    )


def delivery_order(deliveries: DataFrame) -> DataFrame:
    """Summer first, then channels in stored order, newest first inside a channel."""
    return deliveries.orderBy(
        category_rank(F.col("category")), "guild_order", "guild_id", "channel_id", "seq"
    )


def totals_per_listing(deliveries: DataFrame, numbered: DataFrame) -> DataFrame:
    """``category, id`` with its number of deliveries and the sums of their channels and places.

    Deliveries are summed by position, as two numbers are found far faster than two texts; what is
    left, a row per listing, gets its id from ``numbered``, where an id may stand more than once.
    """
    place = [category_rank(F.col("category")).alias("rank"), "position"]
    summed = deliveries.groupBy(*place).agg(
        F.count("*").alias("deliveries"), F.sum("channel_id").alias("channels"), F.sum("seq").alias("places")
    )
    named = numbered.select("category", "id", *place).join(summed.hint("merge"), ["rank", "position"])
    return named.groupBy("category", "id").agg(*[F.sum(c).alias(c) for c in ("deliveries", "channels", "places")])
