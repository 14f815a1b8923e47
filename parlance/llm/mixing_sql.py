"""DuckDB SQL for the mixing query: the same rows by ordering every source whole."""

SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS own,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
g AS (SELECT *, own || '|' || row_number() OVER (PARTITION BY own) AS key, 7 + length(bin(greatest(size, 1))) AS g FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM g GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         source_size * 3 AS cap FROM s),
r AS (
  SELECT *,
    coalesce(sum(cap) OVER p, 0)::BIGINT AS limited, coalesce(sum(weight) OVER p, 0)::BIGINT AS lighter,
    sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights
  FROM w WINDOW p AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - limited)::DOUBLE / (weights - lighter)::DOUBLE AS level FROM r),
m AS (SELECT max(CASE WHEN level * weight::DOUBLE <= cap::DOUBLE THEN level END) AS water FROM l),
t AS (SELECT source, source_size, least(coalesce(water * weight::DOUBLE, cap::DOUBLE), cap::DOUBLE) AS target FROM l, m),
k AS (SELECT g.source, g, sum(size)::BIGINT AS words FROM g GROUP BY g.source, g),
c1 AS (
  SELECT k.source, k.g, t.source_size, t.target,
    coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY k.g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
    sum(words * k.g) OVER (PARTITION BY k.source ORDER BY k.g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
c2 AS (SELECT *, CASE WHEN rest > 0 THEN (target - (3 * above)::DOUBLE) / rest::DOUBLE ELSE 0.0::DOUBLE END AS c FROM c1),
c3 AS (
  SELECT source, g, source_size, target,
    coalesce(max(CASE WHEN c * g::DOUBLE <= 3 THEN c END) OVER (PARTITION BY source), 3.0::DOUBLE) AS c FROM c2),
c4 AS (SELECT *, least(greatest(c * g::DOUBLE, 0.0::DOUBLE), 3.0::DOUBLE) AS rate FROM c3),
o AS (
  SELECT g.doc_id, g.source, g.key, g.size, c4.source_size, c4.target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part,
    (('0x' || substr(md5('mix-1|' || g.key), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM g JOIN c4 ON g.source IS NOT DISTINCT FROM c4.source AND g.g = c4.g),
q AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) * (1 - part) / part END AS ratio FROM o),
v AS (
  SELECT *, target - (sum(whole * size) OVER (PARTITION BY source))::DOUBLE AS missing,
    CASE WHEN ratio IS NOT NULL THEN sum(CASE WHEN ratio IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY ratio NULLS LAST, key ROWS UNBOUNDED PRECEDING) END::DOUBLE AS upto
  FROM q),
f AS (
  SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN ratio IS NOT NULL AND (upto <= missing OR upto - missing < missing - (upto - size)) THEN 1 ELSE 0 END ELSE 0 END AS copies FROM v)
SELECT doc_id, source, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM f
"""
