"""Registered queries: every operator over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingloom.functions import cards, season, strict, text
from listingloom.operators import diff, ranking, replay, routing, select, stats, subscribing
from listingloom.plans import runs
from listingloom.schema import LISTING
from listingloom.session import prepare, scratch, short_lived_shuffles
from listingloom.sources import deliveries, feed, folders, settings, split_array, subscriptions, tables
from listingloom.sources.ledger import Ledger
from listingloom.sources.params import DAY, RunParams, run_params
from listingloom.streaming import keyed, manifest
from listingloom.streaming.manifest import Entry
from listingloom.streaming.runs import diff_batch, listing_run, start_catch_up, start_runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Registers a query under its name; it runs in a prepared session."""

    @wraps(fn)
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = prepared
    return prepared


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = tables.params(spark, sf_dir).start
    return select.current(tables.listings(spark, sf_dir, posted_from=start), start)


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[RunParams, RunParams]:
    """The run 30 days earlier and the present one."""
    now = tables.as_of(spark, sf_dir)
    return tables.params_at(now, days_ago=30), tables.params_at(now)


def _looked_at(listings: DataFrame, run: RunParams) -> DataFrame:
    return select.current(listings.filter(F.col("date_posted") <= run.as_of), run.start)


def _previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run 30 days earlier looked at."""
    then, _ = _two_runs(spark, sf_dir)
    return _looked_at(tables.listings(spark, sf_dir, posted_from=then.start), then)


def _new(spark: SparkSession, sf_dir: str, listings: DataFrame | None = None, find=diff.new_listings) -> DataFrame:
    """Both runs read one derivation of the listings, so that Spark shuffles it once."""
    then, now = _two_runs(spark, sf_dir)
    if listings is None:
        listings = tables.listings(spark, sf_dir, posted_from=then.start)
    return find(select.current(listings, now.start), diff.all_ids(_looked_at(listings, then)))


def _live_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.live_subscriptions(
        tables.subscriptions(spark, sf_dir), tables.live_channels(spark, sf_dir)
    )


def _deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stored = ranking.store_newest_first(_new(spark, sf_dir), scratch(spark, "new"))
    counts = stats.new_counts(stored)
    return (
        routing.deliveries(
            ranking.with_positions(stored), _live_subscriptions(spark, sf_dir), counts
        ),
        counts,
    )


def _flat_card(card: str = "card") -> list:
    return [
        F.col(f"{card}.title").alias("card_title"),
        F.col(f"{card}.color").alias("color"),
        F.col(f"{card}.description").alias("description"),
        cards.fields_text(F.col(f"{card}.fields")).alias("fields"),
    ]


# Expressions


@query
def season_flags(spark, sf_dir):
    return tables.listings(spark, sf_dir).select(
        "id",
        season.is_summer(F.col("terms")).alias("is_summer"),
        season.is_offseason(F.col("terms")).alias("is_offseason"),
    )


@query
def listing_category(spark, sf_dir):
    return select.postable(tables.listings(spark, sf_dir)).select(
        "id", F.coalesce(season.category(F.col("terms")), F.lit("none")).alias("category")
    )


@query
def location_text(spark, sf_dir):
    return tables.listings(spark, sf_dir).select(
        "id", text.location_text(F.col("locations")).alias("location")
    )


@query
def posted_date_text(spark, sf_dir):
    return tables.listings(spark, sf_dir).select(
        "id", text.date_text(F.col("date_posted")).alias("posted")
    )


@query
def listing_card(spark, sf_dir):
    return runs.with_cards(tables.listings(spark, sf_dir)).select(
        "id", F.col("card.url").alias("url"), *_flat_card(), F.col("card.footer").alias("footer")
    )


@query
def channel_mention(spark, sf_dir):
    """Every order's customer as a channel; pending ones have none, failed ones zero."""
    orders = tables.table(spark, sf_dir, "orders")
    channel = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey")).when(
        F.col("o_orderstatus") == "F", F.lit(0)
    )
    return orders.select("o_orderkey", text.channel_mention(channel).alias("mention"))


@query
def interval_text(spark, sf_dir):
    """Event values as hours, for views in whole hours."""
    events = tables.table(spark, sf_dir, "events")
    hours = F.when(F.col("event_type") == "view", F.floor("value").cast("double")).otherwise(
        F.col("value")
    )
    return events.select("event_id", text.interval_text(hours).alias("interval"))


# Selection, order, top-k, counters


@query
def current_listings(spark, sf_dir):
    return select.newest_first(_current(spark, sf_dir)).select("category", "id", "date_posted")


@query
def newest_first(spark, sf_dir):
    stored = ranking.store_newest_first(_current(spark, sf_dir), scratch(spark, "order"))
    return ranking.with_positions(stored).select("category", "position", "id")


@query
def scrape_counters(spark, sf_dir):
    start = tables.params(spark, sf_dir).start
    return stats.scrape_counters(tables.listings(spark, sf_dir), start)


@query
def latest_per_category(spark, sf_dir):
    return select.latest_per_category(_current(spark, sf_dir)).select(
        "category", "position", "id", "date_posted"
    )


@query
def preview(spark, sf_dir):
    params = tables.params(spark, sf_dir)
    listings = tables.listings(spark, sf_dir, posted_from=params.start)
    return runs.preview(listings, params).select("category", "position", *_flat_card())


# New listings and their state


@query
def new_listings(spark, sf_dir):
    return _new(spark, sf_dir).select("category", "id", "company_name", "date_posted")


@query
def new_listings_narrow(spark, sf_dir):
    """From stored listings, of which the narrow comparison reads two columns."""
    path = scratch(spark, "listings")
    tables.listings(spark, sf_dir).write.parquet(path)
    landed = spark.read.schema(LISTING).parquet(path)
    return _new(spark, sf_dir, landed, diff.new_listings_narrow).select(
        "category", "id", "company_name", "date_posted"
    )


@query
def new_counts(spark, sf_dir):
    return stats.new_counts(_new(spark, sf_dir))


@query
def seen_ids(spark, sf_dir):
    return diff.all_ids(_previous(spark, sf_dir))


@query
def seen_replaced(spark, sf_dir):
    """The seen set as stored after two runs: the second's ids only."""
    root = scratch(spark, "seen")
    ledger = Ledger(spark, root)
    for run_no, rows in enumerate((_previous(spark, sf_dir), _current(spark, sf_dir)), 1):
        ledger.replace_seen(run_no, rows)
        ledger.commit(run_no, executed=True)
    return Ledger(spark, root).seen()


# Routing and delivery


@query
def fan_out(spark, sf_dir):
    return _deliveries(spark, sf_dir)[0].select("category", "guild_id", "channel_id", "id")


@query
def delivery_order(spark, sf_dir):
    return routing.delivery_order(_deliveries(spark, sf_dir)[0]).select(
        "channel_id", "seq", "category", "id"
    )


@query
def delivery_stats(spark, sf_dir):
    """Attempts at the deliveries of a run, logged and read back: each one's last outcome."""
    made, counts = _deliveries(spark, sf_dir)
    path = scratch(spark, "attempts")
    deliveries.record_attempts(tables.delivery_attempts(made, run_no=2), path)
    log = deliveries.read_log(spark, path)
    return stats.delivery_stats(log.filter(F.col("run_no") == 2), counts)


def _ledger_of_two_runs(spark: SparkSession, sf_dir: str) -> Ledger:
    """Two full runs through the ledger over a stored feed."""
    ledger, path = Ledger(spark, scratch(spark, "runs")), scratch(spark, "listings")
    before, now = _two_runs(spark, sf_dir)
    tables.listings(spark, sf_dir, posted_from=before.start).write.parquet(path)
    stored = spark.read.schema(LISTING).parquet(path)
    for run_no, params in enumerate((before, now), 1):
        runs.gated_run(
            ledger,
            run_no,
            stored.filter(F.col("date_posted") <= params.as_of),
            tables.subscriptions(spark, sf_dir),
            tables.live_channels(spark, sf_dir),
            params,
        )
    return ledger


@query
def run_outbox(spark, sf_dir):
    """What is to be sent after the second of two runs, with its cards."""
    sent = runs.outbox(_ledger_of_two_runs(spark, sf_dir)).filter(F.col("run_no") == 2)
    return sent.select("category", "guild_id", "channel_id", "seq", "id", *_flat_card())


@query
def run_statistics(spark, sf_dir):
    return runs.statistics(_ledger_of_two_runs(spark, sf_dir))


@query
def count_card(spark, sf_dir):
    report = runs.count_cards(_ledger_of_two_runs(spark, sf_dir))
    return report.select(
        "run_no", F.col("card.title").alias("card_title"), F.col("card.color").alias("color"),
        cards.fields_text(F.col("card.fields")).alias("fields"),
    )


@query
def preview_header(spark, sf_dir):
    params = tables.params(spark, sf_dir)
    return runs.preview_header(tables.listings(spark, sf_dir, posted_from=params.start), params)


@query
def fan_out_sliced(spark, sf_dir):
    """New listings to all customers that have set a channel, by slices; totals per listing."""
    stored = ranking.store_newest_first(_new(spark, sf_dir), scratch(spark, "new"))
    numbered = ranking.with_positions(stored)
    made = routing.deliveries(
        numbered, _subscribed(spark, sf_dir), stats.new_counts(stored), broadcast_rows=200, rows_per_task=200_000
    )
    return routing.totals_per_listing(made, numbered)


# Subscriptions


@query
def channel_admission(spark, sf_dir):
    changes = tables.channel_changes(spark, sf_dir)
    checked = subscribing.admit(changes, tables.channel_facts(spark, sf_dir))
    return checked.select(
        "seq",
        "guild_id",
        "category",
        "channel_id",
        F.coalesce("refusal", F.lit("admitted")).alias("outcome"),
    )


def _subscribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.apply_subscription_changes(
        tables.channel_changes(spark, sf_dir), tables.channel_facts(spark, sf_dir)
    )[0]


@query
def subscription_upsert(spark, sf_dir):
    return _subscribed(spark, sf_dir)


def _stored_changes(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "changes")
    subscriptions.record_changes(
        tables.channel_changes(spark, sf_dir), tables.channel_facts(spark, sf_dir), path
    )
    return path


@query
def summer_channels(spark, sf_dir):
    """From the stored log, all channels of a category, repeats included."""
    stored = subscriptions.read_subscriptions(spark, _stored_changes(spark, sf_dir))
    return subscribing.category_channels(stored, "summer")


@query
def guild_channels(spark, sf_dir):
    """From the stored log, the channels of the guild that was first stored."""
    stored = subscriptions.read_subscriptions(spark, _stored_changes(spark, sf_dir))
    first = stored.agg(F.min_by("guild_id", "guild_order")).first()[0]
    return subscribing.guild_channels(stored, first)


@query
def stored_settings(spark, sf_dir):
    """Settings after all changes, and how many changes were refused for each reason."""
    path = scratch(spark, "settings")
    refused = settings.record_settings(tables.setting_changes(spark, sf_dir), path)
    count = lambda reason: F.count_if(F.col("refusal") == reason).alias(reason)
    return settings.read_settings(spark, path).join(
        F.broadcast(refused.agg(count("bad_interval"), count("bad_start"), count("nothing_set")))
    )


@query
def category_channels(spark, sf_dir):
    """Channels of all guilds in stored order within their category."""
    stored = ranking.store_in_order(
        _subscribed(spark, sf_dir),
        [season.category_rank(F.col("category")), F.col("guild_order")],
        scratch(spark, "channels"),
    )
    return ranking.with_positions(stored).select("category", "position", "channel_id")


@query
def run_gates(spark, sf_dir):
    return subscribing.gates(_subscribed(spark, sf_dir))


@query
def config_report(spark, sf_dir):
    params = run_params(tables.as_of(spark, sf_dir), interval_hours=0.5)
    report = runs.config_report(
        tables.guilds(spark, sf_dir), _subscribed(spark, sf_dir), params
    ).select("guild_id", *_flat_card())
    return report.withColumn("description", F.coalesce("description", F.lit("")))


# Feed ingest


@query
def json_validate(spark, sf_dir):
    rules = [strict.Rule("k", T.LongType())]
    bodies = feed.spread(tables.event_bodies(spark, sf_dir))
    checked = strict.validate(feed.parse_bodies(bodies), rules)
    return checked.select("event_id", "k", F.coalesce("reject_reason", F.lit("")).alias("reason"))


@query
def json_rejects(spark, sf_dir):
    rules = [strict.Rule("k", T.LongType())]
    bodies = feed.spread(tables.event_bodies(spark, sf_dir))
    checked = strict.validate(feed.parse_bodies(bodies), rules)
    # A condition on the count, unlike one on the reason, stays above the validation.
    return checked.groupBy("reject_reason").agg(F.count("reject_reason").alias("records")).filter("records > 0")


@query
def feed_validate(spark, sf_dir):
    """Every record of the listing feed with its typed fields or its reject reason."""
    bodies = feed.spread(tables.listing_bodies(spark, sf_dir))
    checked = strict.validate(feed.parse_bodies(bodies))
    ok = F.col("reject_reason").isNull()
    return checked.select(
        "line_key",
        F.coalesce("reject_reason", F.lit("")).alias("reason"),
        F.when(ok, F.col("id")).alias("id"),
        F.when(ok, F.col("company_name")).alias("company_name"),
        F.when(ok, F.array_join("locations", "|")).alias("locations"),
        F.when(ok, F.array_join("terms", "|")).alias("terms"),
        F.when(ok, F.col("active")).alias("active"),
        F.when(ok, F.col("date_posted")).alias("date_posted"),
        F.when(ok, F.col("source")).alias("source"),
        F.when(ok, F.col("company_url")).alias("company_url"),
    )


@query
def feed_landed(spark, sf_dir):
    """The feed written as line files, read back, validated and stored; its counters."""
    path = scratch(spark, "lines")
    feed.store_lines(tables.listing_bodies(spark, sf_dir).select("body"), path)
    landed = feed.land(feed.read_lines(spark, path), scratch(spark, "landed"))
    start = tables.params(spark, sf_dir).start
    return stats.scrape_counters(landed, start, accepted=F.col("accepted"))


@query
def feed_array(spark, sf_dir):
    """Array documents of three elements: a record, a text, the record again.

    A record that is not JSON stands in its document as a text.
    """
    bodies = feed.spread(tables.listing_bodies(spark, sf_dir))
    quoted = F.to_json(F.array("body"))
    element = F.when(F.col("sound"), F.col("body")).otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    )
    document = F.concat(F.lit("[ "), element, F.lit(', "text",\n'), element, F.lit(" ]"))
    records = feed.explode_documents(bodies.select("line_key", document.alias("document")))
    return strict.validate(records).select(
        "line_key",
        F.col("place").cast("bigint").alias("place"),
        F.coalesce("reject_reason", F.lit("")).alias("reason"),
    )


# Line items whose documents are on disk at the same time: some 4 GB of text, and half of that in pieces and shuffles.
LINES_AT_ONCE = 12_000_000
ELEMENTS = "doc bigint, place bigint, id string, reason string"


def _store_elements(spark: SparkSession, documents: DataFrame, into: str) -> None:
    """Writes array documents, reads them by blocks and stores each element's outcome as ``ELEMENTS``.

    The documents and their pieces are removed then.
    """
    path, pieces = scratch(spark, "documents"), scratch(spark, "pieces")
    documents.write.partitionBy("doc").text(path)
    checked = strict.validate(split_array.read_split_array(spark, path, pieces))
    checked.select(
        F.regexp_extract("ordinal.file", r"/doc=(\d+)/", 1).cast("bigint").alias("doc"),
        F.col("ordinal.place").alias("place"),
        F.when(F.col("reject_reason").isNull(), F.col("id")).alias("id"),
        F.coalesce("reject_reason", F.lit("")).alias("reason"),
    ).write.parquet(into)
    folders.remove(spark, path)
    folders.remove(spark, pieces)


@query
def feed_array_split(spark, sf_dir):
    """Large array documents, each read by many tasks: every element with its outcome.

    Documents are as large as text as all line items are: they are written and read in ranges, so
    that the disk holds one range of them at a time.
    """
    ranges = tables.document_ranges(spark, sf_dir, LINES_AT_ONCE)
    # The outer ends are open: what has no number is left to fail where documents are read.
    starts = [None, *(first for first, _ in ranges[1:])]
    ends = [*(last for _, last in ranges[:-1]), None]
    stored = [scratch(spark, "elements") for _ in starts]
    with short_lived_shuffles(spark):
        for first, last, into in zip(starts, ends, stored, strict=True):
            _store_elements(spark, tables.listing_documents(spark, sf_dir, first, last), into)
    return spark.read.schema(ELEMENTS).parquet(*stored)


# Histories and streams


@query
def snapshot_replay(spark, sf_dir):
    return replay.replay(tables.event_snapshots(spark, sf_dir)).select(
        "run_no", "category", "id", "event_id"
    )


def _in_two_goes(spark: SparkSession, listed: str, entries: list[Entry], root: str, run) -> None:
    """A manifest file and a batch per run; stopped half way, reopened and gone on with."""
    state, half = scratch(spark, "stream"), len(entries) // 2
    for some in (entries[:half], entries[half:]):
        for entry in some:
            manifest.append(spark, listed, [entry])
        source = manifest.read_stream(spark, listed, files_per_batch=1)
        start_runs(source, Ledger(spark, root), run, state).awaitTermination()


def _land_event_snapshots(spark: SparkSession, sf_dir: str) -> list[Entry]:
    """Stores each snapshot in a folder; one manifest entry per day, also for a day without events."""
    path = scratch(spark, "snapshots")
    rows = tables.event_snapshots(spark, sf_dir)
    rows.write.partitionBy("run_no").parquet(path)
    first, last = rows.agg(F.min("run_no"), F.max("run_no")).first()
    return [Entry(n, f"{path}/run_no={n}", n * DAY) for n in range(first, last + 1)]


@query
def stream_new(spark, sf_dir):
    """The history as a stream of snapshots: each batch catches up with all of its runs at once.

    Stopped half way, reopened and gone on with.
    """
    entries = _land_event_snapshots(spark, sf_dir)
    root, listed, state = scratch(spark, "ledger"), scratch(spark, "manifest"), scratch(spark, "stream")
    stored = spark.read.schema("category string, id string, event_id bigint, run_no bigint").parquet(
        os.path.dirname(entries[0].snapshot)
    )

    def read_rows(some: list[Entry]) -> DataFrame:
        return stored.filter(F.col("run_no").between(some[0].run_no, some[-1].run_no))

    half = len(entries) // 2
    for some in (entries[:half], entries[half:]):
        manifest.append(spark, listed, some)
        source = manifest.read_stream(spark, listed)
        start_catch_up(source, Ledger(spark, root), diff_batch(read_rows), state).awaitTermination()
    ledger = Ledger(spark, root)
    new = ledger.read("new", "category string, id string, event_id bigint")
    return new.select("run_no", "category", "id", "event_id")


@query
def stream_new_keyed(spark, sf_dir):
    """The history as a stream of keys with keyed state; new keys pick the rows."""
    rows = tables.event_snapshots(spark, sf_dir)
    landed, fresh, state = scratch(spark, "keys"), scratch(spark, "fresh"), scratch(spark, "stream")
    first, last = rows.agg(F.min("run_no"), F.max("run_no")).first()
    middle = (first + last) // 2
    # Weeks of the history, each landed by itself and made distinct in parallel; stopped half way and
    # gone on with. A batch takes all files that are there, as a week may be any number of them.
    for low, high in ((first, middle), (middle + 1, last)):
        for week in range(low, high + 1, 7):
            part = rows.filter(F.col("run_no").between(week, min(week + 6, high)))
            keyed.land_keys(part, landed)
        stream = keyed.fresh_keys(keyed.read_keys(spark, landed)).writeStream
        stream.format("parquet").option("path", fresh).option("checkpointLocation", state).trigger(
            availableNow=True
        ).start().awaitTermination()
    keys = spark.read.schema(keyed.KEYS).parquet(fresh)
    return rows.join(keys, ["category", "id", "run_no"], "left_semi").select(
        "run_no", "category", "id", "event_id"
    )


@query
def rolling_runs(spark, sf_dir):
    """Five scheduled runs, 30 days apart, each looking 60 days back; outboxes of all.

    At run 3 nobody is subscribed to offseason: it is skipped, and run 4 compares
    with run 2.
    """
    end = tables.as_of(spark, sf_dir)
    path, listed = scratch(spark, "listings"), scratch(spark, "manifest")
    tables.listings(spark, sf_dir, posted_from=end - 180 * DAY).write.parquet(path)
    entries = []
    for n in range(1, 6):
        as_of = end - (5 - n) * 30 * DAY
        entries.append(Entry(n, f"{path}-{n}", as_of))
    stored = spark.read.schema(LISTING).parquet(path)
    subscribed = tables.subscriptions(spark, sf_dir)
    summer_only = subscribed.filter(F.col("category") == "summer")
    for entry in entries:
        stored.filter(F.col("date_posted") <= entry.as_of).write.parquet(entry.snapshot)

    def snapshot(path: str) -> DataFrame:
        return spark.read.schema(LISTING).parquet(path)

    root = scratch(spark, "ledger")
    run = listing_run(
        lambda entry: snapshot(entry.snapshot),
        lambda entry: summer_only if entry.run_no == 3 else subscribed,
        lambda _entry: tables.live_channels(spark, sf_dir),
        lambda entry: run_params(entry.as_of, days_back=60),
    )
    _in_two_goes(spark, listed, entries, root, run)
    ledger = Ledger(spark, root)
    return ledger.read("outbox", runs.OUTBOX).select("run_no", "category", "channel_id", "seq", "id")
