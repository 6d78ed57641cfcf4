from pyspark.sql import functions as F

from listings_data import listing
from listingloom.functions import cards, text
from listingloom.plans import runs
from listingloom.sources.params import run_params


def values(spark, column, items, type):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"n int, v {type}")
    return [r["t"] for r in rows.select("n", column(F.col("v")).alias("t")).orderBy("n").collect()]


def test_location_text(spark):
    items = [["Tromsø", "Bergen, NO"], []]
    assert values(spark, text.location_text, items, "array<string>") == [
        "Tromsø, Bergen, NO",
        "Location not specified",
    ]


def test_date_text_is_padded_and_utc(spark):
    items = [1698969600, 0, -1, 1699055999]
    want = ["November 03, 2023", "January 01, 1970", "December 31, 1969", "November 03, 2023"]
    for zone in ("UTC", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert values(spark, text.date_text, items, "bigint") == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_channel_mention(spark):
    assert values(spark, text.channel_mention, [12, 0, None], "bigint") == [
        "<#12>", "Not configured", "Not configured",
    ]


def test_interval_text(spark):
    items = [0.5, 0.508333333333333, 30.5 / 60, 0.125, 1.0, 6.0, 1.5, 168.0, None]
    assert values(spark, text.interval_text, items, "double") == [
        "30 minutes", "30 minutes", "30 minutes", "8 minutes", "1 hour", "6 hours", "1.5 hours",
        "168 hours", None,
    ]


def test_listing_cards(frame):
    rows = frame([
        listing("a", "Acme", ["Oslo", "Rome"], ["Summer 2026", "Fall 2026"], "Yes"),
        listing("b", "Beta", [], ["Fall 2025"]),
    ])
    a, b = (r["card"] for r in runs.with_cards(rows).orderBy("id").collect())
    assert (a["title"], a["color"], a["description"]) == (
        "Acme - Intern", 0xF1C40F, "☀️ Summer 2026, Fall 2026",
    )
    assert [(f["name"], f["value"], f["inline"]) for f in a["fields"]] == [
        ("📍 Location", "Oslo, Rome", True),
        ("📅 Posted", "November 19, 2024", True),
        ("🛂 Sponsorship", "Yes", True),
    ]
    assert (a["url"], a["footer"]) == ("https://example.com/a", "ID: a")
    assert (b["color"], b["description"]) == (0x3498DB, "❄️ Fall 2025")
    assert [f["value"] for f in b["fields"]] == ["Location not specified", "November 19, 2024"]


def test_config_report(spark):
    guilds = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "None")], "guild_id long, guild_name string")
    subs = spark.createDataFrame(
        [(1, "summer", 11, 0), (1, "offseason", 12, 0), (2, "offseason", 22, 1)],
        "guild_id long, category string, channel_id long, guild_order long",
    )
    params = run_params(1763769600, days_back=3, interval_hours=0.5)
    got = {
        r["guild_id"]: (r["card"]["title"], r["card"]["description"], r["fields"])
        for r in runs.config_report(guilds, subs, params)
        .withColumn("fields", cards.fields_text(F.col("card.fields")))
        .collect()
    }
    tail = " | ⏰ Scrape Interval=30 minutes | 📅 Scraping From=Internships posted after November 19, 2025"
    assert got[1] == (
        "⚙️ Configuration for One", None,
        "☀️ Summer Channel=<#11> | ❄️ Off-Season Channel=<#12>" + tail,
    )
    assert got[2][2].startswith("☀️ Summer Channel=Not configured | ❄️ Off-Season Channel=<#22>")
    assert got[3][1].startswith("No channels configured yet.")


def test_config_card_without_interval(spark):
    card = cards.config_card(F.lit("G"), F.lit(1), F.lit(2), F.lit(0))
    row = spark.range(1).select(card.alias("card")).first()["card"]
    assert [f["name"] for f in row["fields"]] == [
        "☀️ Summer Channel", "❄️ Off-Season Channel", "📅 Scraping From",
    ]
