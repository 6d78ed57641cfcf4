"""SQL for the queries that it can express, over the same tables."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
),
by_source AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
),
filled AS (
  SELECT *,
    (SELECT sum(source_size) FROM by_source)
      - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_size,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM by_source WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
),
level AS (
  SELECT max(weights) AS weights, arg_max(rest_size, weights) AS rest_size
  FROM filled WHERE rest_size * weight < 3 * source_size * weights
),
targets AS (
  SELECT f.source, f.source_size,
    CASE WHEN f.rest_size * f.weight >= 3 * f.source_size * f.weights THEN (3 * f.source_size)::DOUBLE
      ELSE (f.weight * l.rest_size)::DOUBLE / l.weights::DOUBLE END AS target
  FROM filled f LEFT JOIN level l ON true
),
parts AS (
  SELECT *, target - whole * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets)
),
hist AS (
  SELECT source, size,
    coalesce(sum(size * n) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS larger,
    sum(size::HUGEINT * size * n) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS squares
  FROM (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY ALL)
  WINDOW d AS (PARTITION BY source ORDER BY size DESC)
),
paced AS (
  SELECT p.source, max((p.rest - h.larger) / h.squares) AS pace
  FROM hist h JOIN parts p ON h.source IS NOT DISTINCT FROM p.source
  WHERE (p.rest - h.larger) / h.squares * h.size <= 1 GROUP BY p.source
),
ready AS (
  SELECT z.doc_id, z.size, p.*,
    (('0x' || md5('mix|' || coalesce(z.doc_id::VARCHAR, ''))[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
    least(1.0::DOUBLE, greatest(coalesce(c.pace, 0), 0) * z.size) AS chance
  FROM sized z JOIN parts p ON z.source IS NOT DISTINCT FROM p.source
  LEFT JOIN paced c ON z.source IS NOT DISTINCT FROM c.source
),
odds AS (
  SELECT *, CASE WHEN chance > 0 AND chance < 1 THEN (u / (1 - u)) * ((1 - chance) / chance) END AS ratio FROM ready
),
keyed AS (
  SELECT *, CASE WHEN ratio IS NOT NULL THEN ratio / (1 + ratio) WHEN chance > 0 THEN 0 ELSE 1 END AS key FROM odds
),
alike AS (
  SELECT source, key, doc_id, size, rest, sum(size) AS words FROM keyed WHERE rest > 0 AND size > 0 GROUP BY ALL
),
sampled AS (
  SELECT source, doc_id, size,
    coalesce(sum(words) OVER (
      PARTITION BY source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
    ), 0) + words / 2 < rest AS yes
  FROM alike
)
SELECT k.doc_id, k.size::BIGINT AS size, k.source_size, k.target,
  k.whole + coalesce(s.yes, false)::INT AS copies, (k.size * (k.whole + coalesce(s.yes, false)::INT))::BIGINT AS taken
FROM keyed k LEFT JOIN sampled s
  ON k.source IS NOT DISTINCT FROM s.source AND k.doc_id IS NOT DISTINCT FROM s.doc_id AND k.size = s.size
"""

ORACLES = {"op8_mixing": MIXING}
