"""The engine's inputs, derived from the order and event tables.

Orders become listings, their open line items give places and terms. See FIXTURES.md
for the recipe; it is mirrored in SQL by the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.sources.params import DAY, RunParams, run_params


# Known columns: reading with them costs no job for looking into the files.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


# Suppliers with the name of their nation: so many rows stay below 10 MB.
FEW = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ntz: Column) -> Column:
    """Unix seconds of a wall time in the session zone, which the engine sets to UTC."""
    return F.unix_seconds(ntz.cast("timestamp"))


def _term(shipped: Column) -> Column:
    month = F.month(shipped)
    # May is written small on purpose: it must not count as a season.
    season = (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4), "Spring")
        .when(month == 5, "summer")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Fall")
    )
    return F.concat_ws(" ", season, F.year(shipped))


def listings(spark: SparkSession, sf_dir: str, posted_from: int | None = None) -> DataFrame:
    """One listing per order.

    ``posted_from`` lets a start date reach the orders scan, and through the orders
    left the line items, before these are joined and grouped.
    """
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "O")
    if posted_from is not None:
        first = F.timestamp_seconds(F.lit(posted_from)).cast("timestamp_ntz")
        orders = orders.filter(F.col("o_orderdate") >= first)
        wanted = orders.select(F.col("o_orderkey").alias("l_orderkey"))
        lines = lines.join(wanted, "l_orderkey", "left_semi")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "n_name"
    )
    # Else the planner may broadcast the line items, as the smaller file, and probe from here.
    if supplier.limit(FEW + 1).count() <= FEW:
        places = F.broadcast(places)
    # Sets, so that copies collapse before the shuffle however many lines an order has.
    details = (
        lines.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_orderkey")
        .agg(
            F.sort_array(F.collect_set("n_name")).alias("locations"),
            F.sort_array(F.collect_set(_term(F.col("l_shipdate")))).alias("terms"),
        )
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    nothing = F.array().cast("array<string>")
    posted = _seconds(F.col("o_orderdate"))
    order_id = F.col("o_orderkey").cast("string")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(details, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            order_id.alias("id"),
            F.col("c_name").alias("company_name"),
            F.col("o_orderpriority").alias("title"),
            F.coalesce("locations", nothing).alias("locations"),
            F.coalesce("terms", nothing).alias("terms"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "")
            .otherwise(F.col("c_mktsegment"))
            .alias("sponsorship"),
            (F.col("o_orderstatus") != "P").alias("active"),
            (F.col("o_orderpriority") != "5-LOW").alias("is_visible"),
            F.concat(F.lit("https://example.com/o/"), order_id).alias("url"),
            posted.alias("date_posted"),
            posted.alias("date_updated"),
            F.lit("").alias("source"),
            F.lit("").alias("company_url"),
        )
    )


def as_of(spark: SparkSession, sf_dir: str) -> int:
    """The newest order date: the moment the snapshot stands for."""
    newest = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("d"))
    return newest.select(_seconds(F.col("d"))).first()[0]


def params_at(now: int, days_ago: int = 0) -> RunParams:
    """A window of one year; ``days_ago`` gives the run that many days earlier."""
    return run_params(now - days_ago * DAY, days_back=365)


def params(spark: SparkSession, sf_dir: str) -> RunParams:
    return params_at(as_of(spark, sf_dir))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as guilds: every second one for summer, every third for offseason."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("bigint")

    def of(category: str, every: int, base: int) -> DataFrame:
        return nation.filter(key % every == 0).select(
            key.alias("guild_id"),
            F.lit(category).alias("category"),
            (key + base).alias("channel_id"),
            key.alias("guild_order"),
        )

    return of("summer", 2, 1000).unionByName(of("offseason", 3, 2000))


def live_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of nations outside region 4 can be reached."""
    nation = table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 4)
    key = F.col("n_nationkey").cast("bigint")
    return nation.select(F.explode(F.array(key + 1000, key + 2000)).alias("channel_id"))


def delivery_attempts(deliveries: DataFrame, run_no: int) -> DataFrame:
    """What a drainer would report: every 89th listing is sent at the second attempt only,
    every 97th fails at both."""
    key = F.col("id").cast("bigint")
    lost = key % 97 == 0
    attempts = F.when(lost | (key % 89 == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = deliveries.withColumn("attempt", F.explode(attempts))
    failed = lost | ((key % 89 == 0) & (F.col("attempt") == 1))
    return rows.select(
        F.lit(run_no).cast("bigint").alias("run_no"), "channel_id", "seq", "attempt", "category", "id",
        F.when(failed, "failed").otherwise("sent").alias("status"),
    )


def setting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of settings: intervals in half hours up to 200 hours, start dates
    of which some lie before 1970; all other orders change nothing."""
    interval = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") % 401 / 2)
    sign = F.when(F.col("o_custkey") % 5 == 0, -1).otherwise(1)
    start = F.when(F.col("o_orderpriority") == "2-HIGH", _seconds(F.col("o_orderdate")) * sign)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        interval.cast("double").alias("scrape_interval_hours"),
        start.alias("scrape_start_timestamp"),
    )


def channel_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as channel changes: a customer is a guild and owns one channel.

    Pending orders ask for the neighbour's channel; urgent and high ones are for summer.
    """
    orders = table(spark, sf_dir, "orders")
    neighbour = F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    category = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "summer")
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("guild_id"),
        category.otherwise("offseason").alias("category"),
        (F.col("o_custkey") + neighbour + 1).alias("channel_id"),
    )


def channel_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as channels: no sending when in debt, no cards in one segment."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("channel_id"),
        F.col("c_custkey").alias("owner_guild_id"),
        (F.col("c_acctbal") >= 0).alias("can_send"),
        (F.col("c_mktsegment") != "BUILDING").alias("can_embed"),
    )


def guilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("guild_id"), F.col("c_name").alias("guild_name")
    )


def event_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as daily snapshots, with copies: the run is the day's number."""
    return table(spark, sf_dir, "events").select(
        F.unix_date(F.col("ts").cast("date")).cast("bigint").alias("run_no"),
        F.col("event_type").alias("category"),
        F.col("user_id").cast("string").alias("id"),
        "event_id",
    )


def event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as JSON texts of which some were damaged in known ways."""
    kind = F.col("event_id") % 10
    body = (
        F.when(kind == 0, F.expr("left(props, length(props) - 1)"))
        .when(kind == 1, '{"k": "x"}')
        .when(kind == 2, "{}")
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))


# A record written field by field. Line numbers, flags, taxes and discounts decide how
# single fields are written.
_RECORD = r"""
concat('{',
  CASE l_quantity WHEN 45 THEN concat('"id": null, "id": "', line_key, '"')
    ELSE concat('"id": ',
      CASE l_linenumber WHEN 7 THEN CAST(l_orderkey AS STRING) ELSE concat('"', line_key, '"') END) END,
  ', "company_name": "Zoë \\"& Co\\"", "title": "Intern", "locations": ',
  CASE l_linenumber WHEN 1 THEN '[]' WHEN 3 THEN '["Oslo", "Bergen"]' WHEN 4 THEN '[null]'
    WHEN 5 THEN '["Oslo", null]' WHEN 6 THEN '["Oslo", 5]' ELSE '["Oslo"]' END,
  ', "terms": ',
  CASE l_returnflag WHEN 'A' THEN '["Summer 2026", "Fall 2026"]'
    WHEN 'N' THEN '["Springfield 2026"]' ELSE '["summer 2026"]' END,
  ', "sponsorship": "", "active": ',
  CASE round(l_discount * 100) WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN '"Yes"'
    WHEN 3 THEN '"t"' WHEN 4 THEN '1.0' WHEN 5 THEN 'false' WHEN 6 THEN '"OFF"' WHEN 7 THEN '0'
    WHEN 8 THEN '2' WHEN 9 THEN '"maybe"' ELSE 'null' END,
  ', "is_visible": "on", "url": "https://example.com/x", "date_posted": ',
  CASE round(l_tax * 100) WHEN 0 THEN posted WHEN 1 THEN concat('" ', posted, '"')
    WHEN 2 THEN concat(posted, '.0') WHEN 3 THEN concat(posted, '.5')
    WHEN 4 THEN concat('"+', posted, '.00"') WHEN 5 THEN '"soon"' WHEN 6 THEN 'true'
    WHEN 7 THEN concat(posted, 'e0') ELSE '[1]' END,
  CASE l_linestatus WHEN 'O' THEN ', "unknown": {"a": [1, {"b": null}]}'
    ELSE ', "company_url": "https://example.com"' END,
  ', "date_updated": ', posted, '}')"""

# Quantities above 45 and below 5 damage the whole record.
_DAMAGED = """
CASE l_quantity WHEN 1 THEN concat(record, ' trailing') WHEN 2 THEN concat(record, record)
  WHEN 3 THEN concat(record, '],[', record) WHEN 4 THEN replace(record, '"', "'") WHEN 50 THEN left(record, length(record) - 1) WHEN 49 THEN '"just text"'
  WHEN 48 THEN '[1, 2]' WHEN 47 THEN 'null' WHEN 46 THEN concat('NULL ', record)
  ELSE record END"""


# Line numbers are not unique: what tells equal ones apart is all that a record is written from.
LINE_ORDER = (
    "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount", "l_tax", "l_linestatus", "l_shipdate",
)
DOCUMENT_ORDERS = 50_000


def listing_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as listing records in JSON, in all the ways a field may be written.

    The oracles know the outcome from the same columns.
    """
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "*",
        "concat_ws('-', l_orderkey, l_linenumber) AS line_key",
        "CAST(unix_seconds(CAST(l_shipdate AS TIMESTAMP)) AS STRING) AS posted",
    )
    return lines.selectExpr("*", f"{_RECORD} AS record").selectExpr(
        "line_key", "l_orderkey", f"{_DAMAGED} AS body", "l_quantity NOT IN (1, 2, 3, 4, 46, 50) AS sound",
        f"struct({', '.join(LINE_ORDER)}) AS line_order",
    )


def document_ranges(spark: SparkSession, sf_dir: str, lines: int) -> list[tuple[int, int]]:
    """First and last document of ranges that hold some ``lines`` line items, or one document."""
    doc = F.floor(F.col("l_orderkey") / DOCUMENT_ORDERS).cast("bigint").alias("doc")
    sizes = table(spark, sf_dir, "lineitem").groupBy(doc).count().filter("doc IS NOT NULL").orderBy("doc")
    ranges, held = [], lines
    for row in sizes.collect():
        if held + row["count"] > lines:
            ranges.append((row.doc, row.doc))
            held = 0
        ranges[-1] = (ranges[-1][0], row.doc)
        held += row["count"]
    return ranges


def listing_documents(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``doc, value``: lines of one large array document per 50,000 order numbers, in order.

    Element 0 is a text; a record that is not JSON stands in the document as a text.
    ``first`` and ``last``, where given, are the documents to begin and to end with.
    """
    bodies, order = listing_bodies(spark, sf_dir), F.col("l_orderkey")
    if first is not None:
        bodies = bodies.filter((order >= first * DOCUMENT_ORDERS) | order.isNull())
    if last is not None:
        bodies = bodies.filter(order < (last + 1) * DOCUMENT_ORDERS)
    bodies = bodies.withColumn(
        "doc", F.floor(F.col("l_orderkey") / DOCUMENT_ORDERS).cast("bigint")
    )
    element = F.when(F.col("sound"), F.col("body")).otherwise(
        F.expr("substring(to_json(array(body)), 2, length(to_json(array(body))) - 2)")
    )
    rows = bodies.select("doc", F.lit(1).alias("part"), "line_order", F.concat(F.lit(", "), element).alias("value"))
    ends = bodies.select("doc").distinct().selectExpr(
        "doc", "inline(array(struct(0 AS part, '[ \"first\"' AS value), struct(2 AS part, ' ]' AS value)))"
    )
    return (
        rows.unionByName(ends, allowMissingColumns=True)
        .repartition("doc")
        .sortWithinPartitions("doc", "part", "line_order")
        .select("doc", "value")
    )
