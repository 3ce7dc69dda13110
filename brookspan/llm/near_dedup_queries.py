"""Query of near deduplication; checked against all pairs on small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brookspan.llm.common import table
from brookspan.llm.near_dedup import near_duplicates


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM w, LATERAL unnest(range(1, greatest(2, len(ws) - 3))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (
  WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b)
  SELECT a AS doc_id, min(b) AS component_id FROM t GROUP BY ALL)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, r.doc_id = r.component_id AS kept
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLES = {"op9_near_dedup": OP9_SQL}
