"""Channel changes: admission checks, last write wins, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.schema import OFFSEASON, SUMMER


def admit(changes: DataFrame, channel_facts: DataFrame) -> DataFrame:
    """Adds ``refusal``: why a channel may not be set, null when it may.

    ``changes``: seq, guild_id, category, channel_id.
    ``channel_facts``: channel_id, owner_guild_id, can_send, can_embed.
    Permissions are checked before ownership; an unknown channel has no permission, and one
    without a known owner belongs to no guild.
    """
    permitted = F.coalesce(F.col("can_send") & F.col("can_embed"), F.lit(False))
    refusal = F.when(~permitted, F.lit("no_permission")).when(
        ~F.col("owner_guild_id").eqNullSafe(F.col("guild_id")), F.lit("other_guild")
    )
    return (
        changes.join(channel_facts, "channel_id", "left")
        .withColumn("refusal", refusal)
        .drop("owner_guild_id", "can_send", "can_embed")
    )


def guild_settings(changes: DataFrame) -> DataFrame:
    """One row per guild: its channel of each category and when it was first stored.

    The last write wins per category. One aggregation, combined before the shuffle.
    """

    def last(category: str) -> Column:
        mine = F.col("category") == category
        return F.max_by(F.when(mine, F.col("channel_id")), F.when(mine, F.col("seq")))

    return changes.groupBy("guild_id").agg(
        last(SUMMER).alias("summer_channel"),
        last(OFFSEASON).alias("offseason_channel"),
        F.min("seq").alias("guild_order"),
    )


def subscriptions(settings: DataFrame) -> DataFrame:
    """Guild settings as (guild, category) rows; categories never set have none."""
    channels = F.array(
        F.struct(F.lit(SUMMER).alias("category"), F.col("summer_channel").alias("channel_id")),
        F.struct(
            F.lit(OFFSEASON).alias("category"), F.col("offseason_channel").alias("channel_id")
        ),
    )
    return settings.select("guild_id", "guild_order", F.inline(channels)).filter(
        F.col("channel_id").isNotNull()
    ).select("guild_id", "category", "channel_id", "guild_order")


def settings_of(subscriptions: DataFrame) -> DataFrame:
    """The inverse of :func:`subscriptions`: (guild, category) rows back to guilds."""

    def channel(category: str) -> Column:
        return F.max(F.when(F.col("category") == category, F.col("channel_id")))

    return subscriptions.groupBy("guild_id").agg(
        channel(SUMMER).alias("summer_channel"),
        channel(OFFSEASON).alias("offseason_channel"),
        F.min("guild_order").alias("guild_order"),
    )


def guild_channels(subscriptions: DataFrame, guild_id: int) -> DataFrame:
    """Point lookup; empty for an unknown guild."""
    return subscriptions.filter(F.col("guild_id") == guild_id)


def category_channels(subscriptions: DataFrame, category: str) -> DataFrame:
    """Channels of a category over all guilds, in stored order, repeats included."""
    return (
        subscriptions.filter(F.col("category") == category)
        .orderBy("guild_order", "guild_id")
        .select("channel_id")
    )


def gates(subscriptions: DataFrame) -> DataFrame:
    """One row: may a scheduled run start (both categories), may a manual one (either)."""
    counted = subscriptions.agg(
        F.count_if(F.col("category") == SUMMER).alias("summer_channels"),
        F.count_if(F.col("category") == OFFSEASON).alias("offseason_channels"),
    )
    has_summer = F.col("summer_channels") > 0
    has_offseason = F.col("offseason_channels") > 0
    return counted.select(
        "summer_channels",
        "offseason_channels",
        (has_summer & has_offseason).alias("scheduled_run"),
        (has_summer | has_offseason).alias("manual_run"),
    )
