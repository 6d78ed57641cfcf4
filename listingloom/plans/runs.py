"""The engine's calls: one full run, the preview, the settings report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.functions.cards import config_card, count_card, listing_card, preview_text
from listingloom.functions.season import category_rank
from listingloom.operators import diff, ranking, routing, select, stats, subscribing
from listingloom.schema import PREVIEW_SIZE
from listingloom.sources.ledger import Ledger
from listingloom.sources.params import RunParams
from listingloom.sources.subscriptions import read_subscriptions, record_changes

OUTBOX = (
    "category string, position bigint, id string, date_posted bigint, guild_id bigint, "
    "channel_id bigint, guild_order bigint, seq bigint"
)
OUTBOX_COLUMNS = [c.split()[0] for c in OUTBOX.split(", ")]
CARDS = (
    "category string, position bigint, card struct<title: string, url: string, color: bigint, "
    "description: string, fields: array<struct<name: string, value: string, inline: boolean>>, "
    "footer: string>"
)


def with_cards(listings: DataFrame) -> DataFrame:
    return listings.withColumn("card", listing_card())


def run_once(
    ledger: Ledger,
    run_no: int,
    listings: DataFrame,
    subscriptions: DataFrame,
    live_channels: DataFrame,
    params: RunParams,
) -> None:
    """A full run: new listings, cards, outbox, statistics, replaced seen set, commit.

    ``listings`` should be stored typed: it is scanned for the new listings and, narrowly, for
    the counters and the seen set. Cards are stored once per listing; deliveries name them by
    category and position. A run that is already committed is left alone.
    """
    if ledger.is_done(run_no):
        return
    current = select.current(listings, params.start)
    new = diff.new_listings(current, ledger.seen())
    stored = ranking.store_newest_first(new, ledger.path("new", run_no))
    counts = stats.new_counts(stored)
    reachable = routing.live_subscriptions(subscriptions, live_channels)
    numbered = ranking.with_positions(stored)
    ledger.write("cards", run_no, with_cards(numbered).select("category", "position", "card"))
    size = routing.sizes(reachable, counts)
    narrow = numbered.select("category", "position", "id", "date_posted")
    ledger.write("outbox", run_no, routing.deliveries(narrow, reachable, counts, size=size).select(*OUTBOX_COLUMNS))
    found = stats.scrape_counters(listings, params.start)
    ledger.write("stats", run_no, stats.run_statistics(found, counts, size.deliveries))
    ledger.replace_seen(run_no, current)
    ledger.commit(run_no, executed=True)


def outbox(ledger: Ledger) -> DataFrame:
    """Deliveries of all executed runs with their cards, to be drained; ``run_no`` is their run."""
    cards = ledger.read("cards", CARDS)
    return ledger.read("outbox", OUTBOX).join(cards, ["run_no", "category", "position"])


def statistics(ledger: Ledger) -> DataFrame:
    """What every executed run found, what of it was new, how many deliveries it made."""
    return ledger.read("stats", stats.STATISTICS)


def gated_run(
    ledger: Ledger,
    run_no: int,
    listings: DataFrame,
    subscriptions: DataFrame,
    live_channels: DataFrame,
    params: RunParams,
    manual: bool = False,
) -> bool:
    """Runs if the gate is open; a skipped run leaves the seen set as it is."""
    if ledger.is_done(run_no):
        return False
    gate = subscribing.gates(subscriptions).first()
    if not (gate["manual_run"] if manual else gate["scheduled_run"]):
        ledger.commit(run_no, executed=False)
        return False
    run_once(ledger, run_no, listings, subscriptions, live_channels, params)
    return True


def channel_set(
    changes: DataFrame,
    channel_facts: DataFrame,
    changes_path: str,
    ledger: Ledger,
    run_no: int,
    listings: DataFrame,
    live_channels: DataFrame,
    params: RunParams,
) -> tuple[DataFrame, bool]:
    """Records channel changes and runs at once if both categories then have a channel.

    Returns the refused changes with their reason, and whether there was a run.
    """
    refused = record_changes(changes, channel_facts, changes_path)
    spark = changes.sparkSession
    subscriptions = read_subscriptions(spark, changes_path)
    if not subscribing.gates(subscriptions).first()["scheduled_run"]:
        return refused, False
    return refused, gated_run(ledger, run_no, listings, subscriptions, live_channels, params)


def preview_header(listings: DataFrame, params: RunParams) -> DataFrame:
    """One row ``header``: the totals that are shown above the preview."""
    found = stats.scrape_counters(listings, params.start)
    return found.select(preview_text(F.col("summer_found"), F.col("offseason_found")).alias("header"))


def count_cards(ledger: Ledger) -> DataFrame:
    """``run_no, card``: the card of new listings of every executed run."""
    return statistics(ledger).select("run_no", count_card(F.col("summer_new"), F.col("offseason_new")).alias("card"))


def preview(listings: DataFrame, params: RunParams, k: int = PREVIEW_SIZE) -> DataFrame:
    """Cards of the newest ``k`` per category; touches no state."""
    latest = select.latest_per_category(select.current(listings, params.start), k)
    return with_cards(latest).orderBy(category_rank(F.col("category")), "position")


def apply_subscription_changes(
    changes: DataFrame, channel_facts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Admitted changes as subscriptions, and the refused changes with their reason."""
    checked = subscribing.admit(changes, channel_facts)
    allowed = checked.filter(F.col("refusal").isNull())
    refused = checked.filter(F.col("refusal").isNotNull())
    return subscribing.subscriptions(subscribing.guild_settings(allowed)), refused


def config_report(guilds: DataFrame, subscriptions: DataFrame, params: RunParams) -> DataFrame:
    """A settings card per guild, also for guilds without a channel.

    ``guilds``: guild_id, guild_name.
    """
    settings = subscribing.settings_of(subscriptions).drop("guild_order")
    card = config_card(
        F.col("guild_name"),
        F.col("summer_channel"),
        F.col("offseason_channel"),
        F.lit(params.start),
        F.lit(params.interval_hours),
    )
    return guilds.join(settings, "guild_id", "left").select("guild_id", card.alias("card"))
