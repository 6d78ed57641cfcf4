"""The same results in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from listingloom import schema as S
from listingloom.sources.tables import DOCUMENT_ORDERS, LINE_ORDER

_DAY = 86400

_LISTINGS = f"""
details AS (
  SELECT l_orderkey,
         list_sort(list(DISTINCT n_name)) AS locations,
         list_sort(list(DISTINCT
           CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter'
                WHEN month(l_shipdate) IN (3, 4) THEN 'Spring'
                WHEN month(l_shipdate) = 5 THEN 'summer'
                WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer'
                ELSE 'Fall' END || ' ' || year(l_shipdate))) AS terms
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  WHERE l_linestatus = 'O'
  GROUP BY l_orderkey
),
bare AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, c_name AS company_name,
         o_orderpriority AS title,
         coalesce(locations, []) AS locations, coalesce(terms, []) AS terms,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS sponsorship,
         o_orderstatus <> 'P' AS active, o_orderpriority <> '5-LOW' AS is_visible,
         CAST(epoch(o_orderdate) AS BIGINT) AS date_posted
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN details ON o_orderkey = l_orderkey
),
listings AS (
  SELECT *,
         len(list_filter(terms, lambda t: contains(t, 'Summer'))) > 0 AS is_summer,
         len(list_filter(terms, lambda t: regexp_matches(t, 'Fall|Winter|Spring'))) > 0
           AS is_offseason,
         CASE WHEN len(locations) = 0 THEN '{S.NO_LOCATION}'
              ELSE array_to_string(locations, ', ') END AS location,
         strftime(to_timestamp(date_posted) AT TIME ZONE 'UTC', '%B %d, %Y') AS posted
  FROM bare
),
clock AS (SELECT max(date_posted) AS as_of FROM listings),
candidates AS (
  SELECT l.*, CASE WHEN is_summer THEN 'summer' WHEN is_offseason THEN 'offseason' END AS category
  FROM listings l WHERE active AND is_visible
),
seasonal AS (SELECT * FROM candidates WHERE category IS NOT NULL)"""

_CURRENT = f"""{_LISTINGS},
cur AS (SELECT s.* FROM seasonal s, clock WHERE date_posted >= as_of - 365 * {_DAY})"""

_NEW = f"""{_CURRENT},
prev AS (
  SELECT s.* FROM seasonal s, clock
  WHERE date_posted >= as_of - 395 * {_DAY} AND date_posted <= as_of - 30 * {_DAY}
),
fresh AS (
  SELECT c.* FROM cur c
  WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.category = c.category AND p.id = c.id)
)"""

_SUBSCRIPTIONS = """
subs AS (
  SELECT CAST(n_nationkey AS BIGINT) AS guild_id, 'summer' AS category,
         CAST(1000 + n_nationkey AS BIGINT) AS channel_id
  FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT), 'offseason', CAST(2000 + n_nationkey AS BIGINT)
  FROM nation WHERE n_nationkey % 3 = 0
),
reachable AS (
  SELECT s.* FROM subs s WHERE channel_id IN (
    SELECT 1000 + n_nationkey FROM nation WHERE n_regionkey <> 4
    UNION ALL SELECT 2000 + n_nationkey FROM nation WHERE n_regionkey <> 4)
)"""

_DELIVERIES = f"""{_NEW},{_SUBSCRIPTIONS},
deliveries AS (
  SELECT f.*, guild_id, channel_id,
         row_number() OVER (
           PARTITION BY channel_id
           ORDER BY CASE WHEN f.category = 'summer' THEN 0 ELSE 1 END, guild_id,
                    date_posted DESC, id) AS seq
  FROM fresh f JOIN reachable r ON f.category = r.category
)"""

_STATISTICS = f"""{_DELIVERIES},
stored AS (SELECT l.* FROM listings l, clock WHERE date_posted >= as_of - 395 * {_DAY}),
statistics AS (
  SELECT CAST(1 AS BIGINT) AS run_no, count(*) AS processed, CAST(0 AS BIGINT) AS filtered,
         (SELECT count(*) FROM prev WHERE category = 'summer') AS summer_found,
         (SELECT count(*) FROM prev WHERE category = 'offseason') AS offseason_found,
         CAST(0 AS BIGINT) AS rejected,
         (SELECT count(*) FROM prev WHERE category = 'summer') AS summer_new,
         (SELECT count(*) FROM prev WHERE category = 'offseason') AS offseason_new,
         (SELECT count(*) FROM prev) AS total_new,
         (SELECT count(*) FROM prev p JOIN reachable r ON p.category = r.category) AS deliveries
  FROM stored, clock WHERE date_posted <= as_of - 30 * {_DAY}
  UNION ALL
  SELECT 2, count(*), count(*) FILTER (active AND is_visible AND date_posted < as_of - 365 * {_DAY}),
         (SELECT count(*) FROM cur WHERE category = 'summer'),
         (SELECT count(*) FROM cur WHERE category = 'offseason'), 0,
         (SELECT count(*) FROM fresh WHERE category = 'summer'),
         (SELECT count(*) FROM fresh WHERE category = 'offseason'),
         (SELECT count(*) FROM fresh), (SELECT count(*) FROM deliveries)
  FROM stored, clock
)"""

_CARD = f"""
company_name || ' - ' || title AS card_title,
CAST(CASE WHEN is_summer THEN {S.GOLD} ELSE {S.BLUE} END AS BIGINT) AS color,
CASE WHEN is_summer THEN '{S.SUMMER_EMOJI}' ELSE '{S.OFFSEASON_EMOJI}' END || ' ' || array_to_string(terms, ', ') AS description,
'{S.LOCATION_FIELD}=' || location || ' | {S.POSTED_FIELD}=' || posted ||
  CASE WHEN sponsorship = '' THEN '' ELSE ' | {S.SPONSORSHIP_FIELD}=' || sponsorship END AS fields"""

_CHECKED = """
changes AS (
  SELECT o_orderkey AS seq, o_custkey AS guild_id,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'summer' ELSE 'offseason' END
           AS category,
         o_custkey + 1 + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS channel_id
  FROM orders
),
checked AS (
  SELECT ch.*,
         CASE WHEN c_custkey IS NULL OR c_acctbal < 0 OR c_mktsegment = 'BUILDING'
                THEN 'no_permission'
              WHEN c_custkey <> guild_id THEN 'other_guild'
              ELSE 'admitted' END AS outcome
  FROM changes ch LEFT JOIN customer ON c_custkey + 1 = channel_id
),
admitted AS (SELECT * FROM checked WHERE outcome = 'admitted'),
subscribed AS (
  SELECT guild_id, category, channel_id,
         (SELECT min(seq) FROM admitted b WHERE b.guild_id = a.guild_id) AS guild_order
  FROM admitted a
  QUALIFY row_number() OVER (PARTITION BY guild_id, category ORDER BY seq DESC) = 1
)"""

_EVENT_REASONS = """
SELECT event_id,
       CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL
            ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       CASE event_id % 10 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'k: bad_type'
            WHEN 2 THEN 'k: missing' ELSE '' END AS reason
FROM events"""

# What each way of writing a field must lead to; no JSON is parsed here.
_FEED = """
lines AS (
  SELECT *, concat_ws('-', l_orderkey, l_linenumber) AS line_key,
         CAST(round(l_tax * 100) AS INT) AS tax, CAST(round(l_discount * 100) AS INT) AS discount,
         CAST(epoch(l_shipdate) AS BIGINT) AS shipped
  FROM lineitem
),
judged AS (
  SELECT *,
         CASE WHEN l_quantity IN (1, 2, 3, 4, 46, 50) THEN 'bad_json'
              WHEN l_quantity IN (47, 48, 49) THEN 'not_an_object'
              WHEN l_linenumber = 7 AND l_quantity <> 45 THEN 'id: bad_type'
              WHEN l_linenumber IN (4, 5, 6) THEN 'locations: bad_type'
              WHEN discount IN (8, 9) THEN 'active: bad_type'
              WHEN discount = 10 THEN 'active: null'
              WHEN tax IN (3, 5, 8) THEN 'date_posted: bad_type'
              ELSE '' END AS reason,
         CASE l_linenumber WHEN 1 THEN '' WHEN 3 THEN 'Oslo|Bergen' ELSE 'Oslo' END AS locations,
         CASE l_returnflag WHEN 'A' THEN 'Summer 2026|Fall 2026' WHEN 'N' THEN 'Springfield 2026'
              ELSE 'summer 2026' END AS terms,
         discount <= 4 AS active,
         CASE tax WHEN 6 THEN 1 ELSE shipped END AS date_posted
  FROM lines
)"""

_REPLAY = f"""
WITH snapshots AS (
  SELECT CAST(floor(epoch(ts) / {_DAY}) AS BIGINT) AS run_no, event_type AS category,
         CAST(user_id AS VARCHAR) AS id, event_id
  FROM events
)
SELECT run_no, category, id, event_id FROM snapshots s
WHERE NOT EXISTS (
  SELECT 1 FROM snapshots p
  WHERE p.category = s.category AND p.id = s.id AND p.run_no = s.run_no - 1)"""

ORACLES: dict[str, str] = {
    "season_flags": f"WITH {_LISTINGS} SELECT id, is_summer, is_offseason FROM listings",
    "listing_category": f"""WITH {_LISTINGS}
        SELECT id, coalesce(category, 'none') AS category FROM candidates""",
    "location_text": f"WITH {_LISTINGS} SELECT id, location FROM listings",
    "posted_date_text": f"WITH {_LISTINGS} SELECT id, posted FROM listings",
    "listing_card": f"""WITH {_LISTINGS}
        SELECT id, 'https://example.com/o/' || id AS url, {_CARD}, 'ID: ' || id AS footer
        FROM listings""",
    "channel_mention": """
        SELECT o_orderkey,
               CASE WHEN o_orderstatus = 'O' AND o_custkey <> 0 THEN '<#' || o_custkey || '>'
                    ELSE 'Not configured' END AS mention
        FROM orders""",
    "interval_text": """
        SELECT event_id,
               CASE WHEN h < 1 THEN CAST(round_even(h * 60, 0) AS BIGINT) || ' minutes'
                    WHEN h = 1 THEN '1 hour'
                    WHEN h = floor(h) THEN CAST(h AS BIGINT) || ' hours'
                    ELSE h || ' hours' END AS interval
        FROM (SELECT event_id,
                     CASE WHEN event_type = 'view' THEN floor(value) ELSE value END AS h
              FROM events)""",
    "current_listings": f"WITH {_CURRENT} SELECT category, id, date_posted FROM cur",
    "newest_first": f"""WITH {_CURRENT}
        SELECT category, id,
               row_number() OVER (PARTITION BY category ORDER BY date_posted DESC, id) AS position
        FROM cur""",
    "scrape_counters": f"""WITH {_CURRENT}
        SELECT (SELECT count(*) FROM listings) AS processed,
               (SELECT count(*) FROM candidates, clock
                WHERE date_posted < as_of - 365 * {_DAY}) AS filtered,
               (SELECT count(*) FROM cur WHERE category = 'summer') AS summer_found,
               (SELECT count(*) FROM cur WHERE category = 'offseason') AS offseason_found,
               CAST(0 AS BIGINT) AS rejected""",
    "latest_per_category": f"""WITH {_CURRENT}
        SELECT category, id, date_posted,
               row_number() OVER (PARTITION BY category ORDER BY date_posted DESC, id) AS position
        FROM cur QUALIFY position <= 5""",
    "preview": f"""WITH {_CURRENT},
        top AS (
          SELECT *, row_number() OVER (PARTITION BY category ORDER BY date_posted DESC, id)
                    AS position
          FROM cur QUALIFY position <= 5)
        SELECT category, position, {_CARD} FROM top""",
    "new_listings": f"WITH {_NEW} SELECT category, id, company_name, date_posted FROM fresh",
    "new_listings_narrow": f"WITH {_NEW} SELECT category, id, company_name, date_posted FROM fresh",
    "new_counts": f"""WITH {_NEW}
        SELECT c.category, count(f.id) AS new_count
        FROM (VALUES ('summer'), ('offseason')) c(category)
        LEFT JOIN fresh f ON f.category = c.category GROUP BY c.category""",
    "seen_ids": f"WITH {_NEW} SELECT DISTINCT category, id FROM prev",
    "seen_replaced": f"WITH {_CURRENT} SELECT DISTINCT category, id FROM cur",
    "fan_out": f"WITH {_DELIVERIES} SELECT category, guild_id, channel_id, id FROM deliveries",
    "delivery_order": f"WITH {_DELIVERIES} SELECT channel_id, seq, category, id FROM deliveries",
    "delivery_stats": f"""WITH {_DELIVERIES}
        SELECT count(*) FILTER (category = 'summer' AND o_orderkey % 97 <> 0) AS summer_posted,
               count(*) FILTER (category = 'offseason' AND o_orderkey % 97 <> 0)
                 AS offseason_posted,
               count(*) FILTER (o_orderkey % 97 = 0) AS errors,
               (SELECT count(*) FROM fresh) AS total_new
        FROM deliveries""",
    "run_outbox": f"""WITH {_DELIVERIES}
        SELECT category, guild_id, channel_id, seq, id, {_CARD} FROM deliveries""",
    "run_statistics": f"""WITH {_STATISTICS}
        SELECT * FROM statistics""",
    "count_card": f"""WITH {_STATISTICS}
        SELECT run_no, '{S.COUNT_TITLE}' AS card_title, CAST({S.GREEN} AS BIGINT) AS color,
               '{S.SUMMER_COUNT_FIELD}=' || summer_new || ' new | {S.OFFSEASON_COUNT_FIELD}=' ||
               offseason_new || ' new' AS fields
        FROM statistics""",
    "preview_header": f"""WITH {_CURRENT}
        SELECT '{S.PREVIEW_TITLE}' || chr(10) || replace(replace(
                 '{S.PREVIEW_TOTALS}', '%d summer', count(*) FILTER (category = 'summer') || ' summer'),
                 '%d off', count(*) FILTER (category = 'offseason') || ' off') || chr(10) ||
               '{S.PREVIEW_NOTE}' AS header
        FROM cur""",
    "fan_out_sliced": f"""WITH {_NEW},{_CHECKED},
        amounts AS (SELECT category, count(*) AS n FROM fresh GROUP BY category),
        starts AS (
          SELECT s.*, coalesce(sum(coalesce(n, 0)) OVER (
                   PARTITION BY channel_id ORDER BY CASE WHEN s.category = 'summer' THEN 0 ELSE 1 END,
                   guild_order, guild_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM subscribed s LEFT JOIN amounts a ON a.category = s.category),
        numbered AS (
          SELECT category, id,
                 row_number() OVER (PARTITION BY category ORDER BY date_posted DESC, id) AS position
          FROM fresh)
        SELECT f.category, f.id, count(*) AS deliveries, CAST(sum(channel_id) AS BIGINT) AS channels,
               CAST(sum(position + before) AS BIGINT) AS places
        FROM numbered f JOIN starts s ON s.category = f.category GROUP BY f.category, f.id""",
    "summer_channels": f"""WITH {_CHECKED}
        SELECT channel_id FROM subscribed WHERE category = 'summer'""",
    "guild_channels": f"""WITH {_CHECKED}
        SELECT guild_id, category, channel_id, guild_order FROM subscribed
        WHERE guild_order = (SELECT min(seq) FROM admitted)""",
    "stored_settings": """
        WITH changes AS (
          SELECT o_orderkey AS seq,
                 CASE WHEN o_orderpriority = '1-URGENT' THEN (o_custkey % 401) / 2 END AS hours,
                 CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(epoch(o_orderdate) AS BIGINT) *
                   CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE 1 END END AS start
          FROM orders),
        kept AS (
          SELECT * FROM changes WHERE (hours IS NULL OR hours BETWEEN 0.5 AND 168)
          AND (start IS NULL OR start > 0))
        SELECT coalesce((SELECT arg_max(hours, seq) FROM kept WHERE hours IS NOT NULL), 6.0::DOUBLE)
                 AS scrape_interval_hours,
               (SELECT arg_max(start, seq) FROM kept WHERE start IS NOT NULL)
                 AS scrape_start_timestamp,
               count(*) FILTER (NOT (hours BETWEEN 0.5 AND 168)) AS bad_interval,
               count(*) FILTER (start <= 0) AS bad_start,
               count(*) FILTER (hours IS NULL AND start IS NULL) AS nothing_set
        FROM changes""",
    "channel_admission": f"""WITH {_CHECKED}
        SELECT seq, guild_id, category, channel_id, outcome FROM checked""",
    "subscription_upsert": f"""WITH {_CHECKED}
        SELECT guild_id, category, channel_id, guild_order FROM subscribed""",
    "category_channels": f"""WITH {_CHECKED}
        SELECT category, channel_id,
               row_number() OVER (PARTITION BY category ORDER BY guild_order) AS position
        FROM subscribed""",
    "run_gates": f"""WITH {_CHECKED}, counted AS (
          SELECT count(*) FILTER (category = 'summer') AS summer_channels,
                 count(*) FILTER (category = 'offseason') AS offseason_channels
          FROM subscribed)
        SELECT *, summer_channels > 0 AND offseason_channels > 0 AS scheduled_run,
               summer_channels > 0 OR offseason_channels > 0 AS manual_run
        FROM counted""",
    "config_report": f"""WITH {_CHECKED}, settings AS (
          SELECT c_custkey AS guild_id, c_name,
                 max(channel_id) FILTER (category = 'summer') AS s,
                 max(channel_id) FILTER (category = 'offseason') AS o
          FROM customer LEFT JOIN subscribed ON c_custkey = guild_id
          GROUP BY c_custkey, c_name)
        SELECT guild_id, '{S.CONFIG_TITLE_PREFIX}' || c_name AS card_title,
               CAST({S.BLURPLE} AS BIGINT) AS color,
               CASE WHEN s IS NULL AND o IS NULL THEN '{S.NO_CHANNELS_HINT}' ELSE '' END
                 AS description,
               '{S.SUMMER_CHANNEL_FIELD}=' || coalesce('<#' || s || '>', '{S.NOT_CONFIGURED}') ||
               ' | {S.OFFSEASON_CHANNEL_FIELD}=' || coalesce('<#' || o || '>', '{S.NOT_CONFIGURED}') ||
               ' | {S.INTERVAL_FIELD}=30 minutes | {S.SINCE_FIELD}={S.SINCE_PREFIX}' ||
               (SELECT strftime(max(o_orderdate) - INTERVAL 3 DAY, '%B %d, %Y') FROM orders)
                 AS fields
        FROM settings""",
    "json_validate": _EVENT_REASONS,
    "json_rejects": f"""
        SELECT reason AS reject_reason, count(*) AS records FROM ({_EVENT_REASONS})
        WHERE reason <> '' GROUP BY reason""",
    "feed_validate": f"""WITH {_FEED}
        SELECT line_key, reason,
               CASE WHEN reason = '' THEN line_key END AS id,
               CASE WHEN reason = '' THEN 'Zoë "& Co"' END AS company_name,
               CASE WHEN reason = '' THEN locations END AS locations,
               CASE WHEN reason = '' THEN terms END AS terms,
               CASE WHEN reason = '' THEN active END AS active,
               CASE WHEN reason = '' THEN date_posted END AS date_posted,
               CASE WHEN reason = '' THEN '' END AS source,
               CASE WHEN reason = '' THEN
                 CASE l_linestatus WHEN 'O' THEN '' ELSE 'https://example.com' END END
                 AS company_url
        FROM judged""",
    "feed_landed": f"""WITH {_FEED}, clock AS (
          SELECT CAST(epoch(max(o_orderdate)) AS BIGINT) - 365 * {_DAY} AS start FROM orders)
        SELECT count(*) FILTER (reason = '') AS processed,
               count(*) FILTER (reason = '' AND active AND date_posted < start) AS filtered,
               count(*) FILTER (reason = '' AND active AND date_posted >= start
                                AND l_returnflag = 'A') AS summer_found,
               count(*) FILTER (reason = '' AND active AND date_posted >= start
                                AND l_returnflag = 'N') AS offseason_found,
               count(*) FILTER (reason <> '') AS rejected
        FROM judged, clock""",
    "feed_array": f"""WITH {_FEED}
        SELECT line_key, CAST(place AS BIGINT) AS place,
               CASE WHEN place = 1 OR reason = 'bad_json' THEN 'not_an_object' ELSE reason END
                 AS reason
        FROM judged, (VALUES (0), (1), (2)) p(place)""",
    "feed_array_split": f"""WITH {_FEED}, placed AS (
          SELECT *, l_orderkey // {DOCUMENT_ORDERS} AS doc,
                 row_number() OVER (PARTITION BY l_orderkey // {DOCUMENT_ORDERS}
                                    ORDER BY {', '.join(LINE_ORDER)}) AS place
          FROM judged)
        SELECT CAST(doc AS BIGINT) AS doc, CAST(place AS BIGINT) AS place,
               CASE WHEN reason = '' THEN line_key END AS id,
               CASE reason WHEN 'bad_json' THEN 'not_an_object' ELSE reason END AS reason
        FROM placed
        UNION ALL
        SELECT DISTINCT CAST(doc AS BIGINT), 0, NULL, 'not_an_object' FROM placed""",
    "snapshot_replay": _REPLAY,
    "stream_new": _REPLAY,
    "stream_new_keyed": _REPLAY,
    "rolling_runs": f"""WITH {_LISTINGS},{_SUBSCRIPTIONS},
        runs AS (
          SELECT run_no, before, as_of - (5 - run_no) * 30 * {_DAY} AS run_as_of
          FROM (VALUES (1, 0), (2, 1), (4, 2), (5, 4)) r(run_no, before), clock),
        held AS (
          SELECT run_no, before, s.* FROM seasonal s JOIN runs
          ON date_posted >= run_as_of - 60 * {_DAY} AND date_posted <= run_as_of),
        fresh AS (
          SELECT h.* FROM held h WHERE NOT EXISTS (
            SELECT 1 FROM held p
            WHERE p.run_no = h.before AND p.category = h.category AND p.id = h.id))
        SELECT CAST(run_no AS BIGINT) AS run_no, f.category, channel_id, id,
               row_number() OVER (
                 PARTITION BY run_no, channel_id
                 ORDER BY CASE WHEN f.category = 'summer' THEN 0 ELSE 1 END, guild_id,
                          date_posted DESC, id) AS seq
        FROM fresh f JOIN reachable r ON f.category = r.category""",
}
