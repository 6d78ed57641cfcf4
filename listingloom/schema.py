"""Row shapes of the engine and the fixed values its results must contain."""

from __future__ import annotations

from pyspark.sql import types as T

# Season words looked for inside a term (case-sensitive).
SUMMER_WORDS = ("Summer",)
OFFSEASON_WORDS = ("Fall", "Winter", "Spring")

# Categories, in delivery order.
SUMMER = "summer"
OFFSEASON = "offseason"
CATEGORIES = (SUMMER, OFFSEASON)

# Card colours (RGB), emoji and texts.
GOLD = 0xF1C40F
BLUE = 0x3498DB
BLURPLE = 0x5865F2
GREEN = 0x2ECC71
SUMMER_EMOJI = "☀️"
OFFSEASON_EMOJI = "❄️"
LOCATION_FIELD = "📍 Location"
POSTED_FIELD = "📅 Posted"
SPONSORSHIP_FIELD = "🛂 Sponsorship"
SUMMER_CHANNEL_FIELD = "☀️ Summer Channel"
OFFSEASON_CHANNEL_FIELD = "❄️ Off-Season Channel"
INTERVAL_FIELD = "⏰ Scrape Interval"
SINCE_FIELD = "📅 Scraping From"
CONFIG_TITLE_PREFIX = "⚙️ Configuration for "
SINCE_PREFIX = "Internships posted after "
COUNT_TITLE = "📊 New Internships Found"
SUMMER_COUNT_FIELD = "☀️ Summer"
OFFSEASON_COUNT_FIELD = "❄️ Off-Season"
PREVIEW_TITLE = "🔍 **Test Scrape Results**"
PREVIEW_TOTALS = "📊 Total found: %d summer, %d off-season"
PREVIEW_NOTE = "Showing 5 most recent from each category:"
NO_LOCATION = "Location not specified"
NOT_CONFIGURED = "Not configured"
NO_CHANNELS_HINT = (
    "No channels configured yet. Use `/set_summer_channel` or "
    "`/set_offseason_channel` to get started!"
)

# Run parameters.
DEFAULT_INTERVAL_HOURS = 6.0
INTERVAL_HOURS_RANGE = (0.5, 168.0)
DEFAULT_DAYS_BACK = 3
DAYS_BACK_RANGE = (1, 365)
PREVIEW_SIZE = 5

# A listing as accepted from the feed.
LISTING = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("company_name", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("locations", T.ArrayType(T.StringType(), False), False),
        T.StructField("terms", T.ArrayType(T.StringType(), False), False),
        T.StructField("sponsorship", T.StringType(), False),
        T.StructField("active", T.BooleanType(), False),
        T.StructField("is_visible", T.BooleanType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("date_posted", T.LongType(), False),
        T.StructField("date_updated", T.LongType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("company_url", T.StringType(), False),
    ]
)

# Text used where a listing field may be left out of the feed.
DEFAULTS = {"source": "", "company_url": ""}

SEEN = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)

# guild_order: when the guild was first stored; it sets the delivery order.
SUBSCRIPTION = T.StructType(
    [
        T.StructField("guild_id", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("channel_id", T.LongType()),
        T.StructField("guild_order", T.LongType()),
    ]
)
