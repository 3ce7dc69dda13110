"""Query and oracle of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brookspan.llm.common import table
from brookspan.llm.mixing import mix


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies", "part")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS null_source, coalesce(source, '') AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('20:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
dealt AS (
  SELECT *, CAST('0x' || substr(place, 1, 8) AS BIGINT)
            % (SELECT greatest(1, ceil(count(*) / 4096.0)::BIGINT) FROM sized) AS shard
  FROM sized),
cells AS (SELECT null_source, source_key, shard, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY ALL),
sources AS (SELECT null_source, source_key, sum(shard_size)::BIGINT AS source_size FROM cells GROUP BY ALL),
weighted AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY null_source, source_key) - 1) % 3] AS weight FROM sources),
levels AS (SELECT *, 2.0::DOUBLE * source_size / weight AS level FROM weighted),
water AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - 2.0::DOUBLE * ((sum(source_size) OVER (ORDER BY level, null_source, source_key ROWS UNBOUNDED PRECEDING)) - source_size)::DOUBLE)
            / (sum(weight) OVER (ORDER BY level, null_source, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS w
  FROM levels),
targets AS (
  SELECT null_source, source_key, source_size,
         least(2.0::DOUBLE * source_size, weight * (SELECT arg_min(w, (level, null_source, source_key)) FROM water WHERE w <= level)) AS target
  FROM water),
all_words AS (SELECT least(floor(1.5 * sum(source_size)), sum(2 * source_size))::BIGINT AS wanted FROM targets),
quotients1 AS (
  SELECT null_source, source_key, least(16 * k, 2 * source_size) - 16 * (k - 1) AS words, target / (2 * k - 1)::DOUBLE AS quotient, k
  FROM targets, LATERAL unnest(range(1, 1 + ceil(2 * source_size / 16)::BIGINT)) AS u(k)),
handed1 AS (
  SELECT *, sum(words) OVER (ORDER BY quotient DESC, null_source, source_key, k ROWS UNBOUNDED PRECEDING) - words AS before FROM quotients1),
won1 AS (
  SELECT null_source, source_key, sum(greatest(0, least(words, (SELECT wanted FROM all_words) - before)))::BIGINT AS source_quota
  FROM handed1 GROUP BY ALL),
cells2 AS (
  SELECT c.*, t.source_size, t.target, coalesce(w.source_quota, 0) AS source_quota
  FROM cells c JOIN targets t USING (null_source, source_key) LEFT JOIN won1 w USING (null_source, source_key)),
quotients2 AS (
  SELECT null_source, source_key, shard, source_quota, least(16 * k, 2 * shard_size) - 16 * (k - 1) AS words,
         shard_size / (2 * k - 1)::DOUBLE AS quotient, k
  FROM cells2, LATERAL unnest(range(1, 1 + ceil(2 * shard_size / 16)::BIGINT)) AS u(k)),
handed2 AS (
  SELECT *, sum(words) OVER (PARTITION BY null_source, source_key ORDER BY quotient DESC, shard, k ROWS UNBOUNDED PRECEDING) - words AS before
  FROM quotients2),
won2 AS (
  SELECT null_source, source_key, shard, sum(greatest(0, least(words, source_quota - before)))::BIGINT AS quota FROM handed2 GROUP BY ALL),
quotas AS (SELECT c.*, coalesce(w.quota, 0) AS quota FROM cells2 c LEFT JOIN won2 w USING (null_source, source_key, shard)),
laid AS (
  SELECT d.*, q.shard_size, q.source_size, q.target, q.quota,
         sum(size) OVER (PARTITION BY null_source, source_key, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
         CASE WHEN q.shard_size > 0 THEN q.quota // q.shard_size ELSE 0 END AS copies
  FROM dealt d JOIN quotas q USING (null_source, source_key, shard))
SELECT doc_id, CASE WHEN NOT null_source THEN source_key END AS source, size, source_size, target,
       (copies * size + greatest(0, least(size, quota - copies * shard_size - before)))::BIGINT AS taken
FROM laid
"""

QUERIES = {"op10_mix": op10_mix}
#: Every quotient of every party is ranked here, by the definition of the method.
ORACLES = {"op10_mix": OP10_SQL}
