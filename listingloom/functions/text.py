"""Texts shown on cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingloom.schema import NO_LOCATION, NOT_CONFIGURED


def location_text(locations: Column) -> Column:
    return F.when(F.size(locations) == 0, F.lit(NO_LOCATION)).otherwise(
        F.concat_ws(", ", locations)
    )


def date_text(unix_seconds: Column) -> Column:
    """``November 03, 2023``: the UTC day, independent of the session zone."""
    day = F.date_from_unix_date(F.floor(unix_seconds / F.lit(86400)).cast("int"))
    return F.date_format(day, "MMMM dd, yyyy")


def channel_mention(channel_id: Column) -> Column:
    """``<#id>``; a null or zero channel counts as not set."""
    return F.when(F.coalesce(channel_id, F.lit(0)) == 0, F.lit(NOT_CONFIGURED)).otherwise(
        F.concat(F.lit("<#"), channel_id.cast("string"), F.lit(">"))
    )


def interval_text(hours: Column) -> Column:
    """Minutes below an hour (rounded half to even), else hours; null stays null."""
    hours = hours.cast("double")
    minutes = F.bround(hours * 60).cast("bigint").cast("string")
    whole = hours == F.floor(hours)
    return (
        F.when(hours < 1, F.concat(minutes, F.lit(" minutes")))
        .when(hours == 1, F.lit("1 hour"))
        .when(whole, F.concat(hours.cast("bigint").cast("string"), F.lit(" hours")))
        .when(hours.isNotNull(), F.concat(hours.cast("string"), F.lit(" hours")))
    )
