"""Cards: the structs a channel is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingloom import schema as S
from listingloom.functions import season, text


def _field(name: str, value: Column, inline: bool) -> Column:
    return F.struct(
        F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline")
    )


def listing_card() -> Column:
    """Card of a listing row; the sponsorship field is left out when empty."""
    summer = season.is_summer(F.col("terms"))
    emoji = F.when(summer, F.lit(S.SUMMER_EMOJI)).otherwise(F.lit(S.OFFSEASON_EMOJI))
    fields = F.array(
        _field(S.LOCATION_FIELD, text.location_text(F.col("locations")), True),
        _field(S.POSTED_FIELD, text.date_text(F.col("date_posted")), True),
        _field(S.SPONSORSHIP_FIELD, F.col("sponsorship"), True),
    )
    shown = F.when(F.col("sponsorship") == "", F.slice(fields, 1, 2)).otherwise(fields)
    return F.struct(
        F.concat_ws(" - ", "company_name", "title").alias("title"),
        F.col("url").alias("url"),
        F.when(summer, F.lit(S.GOLD)).otherwise(F.lit(S.BLUE)).cast("bigint").alias("color"),
        F.concat_ws(" ", emoji, F.concat_ws(", ", "terms")).alias("description"),
        shown.alias("fields"),
        F.concat(F.lit("ID: "), F.col("id")).alias("footer"),
    )


def config_card(
    guild_name: Column,
    summer_channel: Column,
    offseason_channel: Column,
    start: Column,
    interval_hours: Column | None = None,
) -> Column:
    """Card of a guild's settings; the hint shows only when no channel is set."""
    fields = [
        _field(S.SUMMER_CHANNEL_FIELD, text.channel_mention(summer_channel), False),
        _field(S.OFFSEASON_CHANNEL_FIELD, text.channel_mention(offseason_channel), False),
    ]
    if interval_hours is not None:
        fields.append(_field(S.INTERVAL_FIELD, text.interval_text(interval_hours), False))
    since = F.concat(F.lit(S.SINCE_PREFIX), text.date_text(start))
    fields.append(_field(S.SINCE_FIELD, since, False))
    nothing_set = (F.coalesce(summer_channel, F.lit(0)) == 0) & (
        F.coalesce(offseason_channel, F.lit(0)) == 0
    )
    return F.struct(
        F.concat(F.lit(S.CONFIG_TITLE_PREFIX), guild_name).alias("title"),
        F.lit(S.BLURPLE).cast("bigint").alias("color"),
        F.when(nothing_set, F.lit(S.NO_CHANNELS_HINT)).alias("description"),
        F.array(*fields).alias("fields"),
    )


def count_card(summer_new: Column, offseason_new: Column) -> Column:
    """Card of how many new listings a run found."""
    return F.struct(
        F.lit(S.COUNT_TITLE).alias("title"),
        F.lit(S.GREEN).cast("bigint").alias("color"),
        F.array(
            _field(S.SUMMER_COUNT_FIELD, F.format_string("%d new", summer_new), True),
            _field(S.OFFSEASON_COUNT_FIELD, F.format_string("%d new", offseason_new), True),
        ).alias("fields"),
    )


def preview_text(summer_found: Column, offseason_found: Column) -> Column:
    """The lines above the cards of a preview."""
    totals = F.format_string(S.PREVIEW_TOTALS, summer_found, offseason_found)
    return F.concat_ws("\n", F.lit(S.PREVIEW_TITLE), totals, F.lit(S.PREVIEW_NOTE))


def fields_text(fields: Column) -> Column:
    """All fields of a card in one line, for reports and comparisons."""
    return F.array_join(
        F.transform(fields, lambda f: F.concat(f["name"], F.lit("="), f["value"])), " | "
    )
