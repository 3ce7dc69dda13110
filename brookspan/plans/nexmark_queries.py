"""The auction benchmark over the driver's tables: customers are persons, orders auctions, line items bids, parts the side input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookspan.plans import nexmark

PERSON = """c_custkey AS id, c_name AS name, c_name || '@mail' AS emailAddress, CAST(c_custkey AS STRING) AS creditCard, c_mktsegment AS city,
  CASE c_nationkey % 4 WHEN 0 THEN 'OR' WHEN 1 THEN 'ID' WHEN 2 THEN 'CA' ELSE 'AZ' END AS state, c_name AS extra"""
AUCTION = """o_orderkey AS id, o_orderpriority AS itemName, o_orderstatus AS description, CAST(round(o_totalprice * 100) AS BIGINT) AS initialBid,
  CAST(round(o_totalprice * 200) AS BIGINT) AS reserve, o_orderdate AS dateTime, o_orderdate + INTERVAL 30 DAY AS expires, o_custkey AS seller,
  10 + o_orderkey % 5 AS category, o_orderpriority AS extra"""
BID = """l_orderkey AS auction, l_suppkey AS bidder, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
  CASE l_linenumber % 5 WHEN 0 THEN 'Apple' WHEN 1 THEN 'Google' WHEN 2 THEN 'Facebook' WHEN 3 THEN 'Baidu' ELSE 'channel' END AS channel,
  concat('https://www.shop.com/a', l_partkey, '/b', l_suppkey, '/c', l_linenumber, '/item.htm?query=1',
         CASE WHEN l_linenumber % 5 = 4 AND l_partkey % 2 = 0 THEN concat('&channel_id=', l_partkey) ELSE '' END) AS url,
  l_shipdate AS dateTime, concat(l_returnflag, 'c', l_linestatus, l_linenumber) AS extra"""


def tables(spark: SparkSession, sf_dir: str) -> nexmark.Tables:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def made(df: DataFrame, columns: str) -> DataFrame:
        df.createOrReplaceTempView("_nexmark")
        return spark.sql(f"SELECT {columns} FROM _nexmark")

    person = made(read("customer"), PERSON).withColumn("dateTime", F.timestamp_seconds(F.lit(788918400) + F.col("id") % 1000 * 86400).cast("timestamp_ntz"))
    return {
        "person": person, "auction": made(read("orders"), AUCTION), "bid": made(read("lineitem"), BID),
        "side_input": read("part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value")),
    }


_WITH = f"""WITH person AS (SELECT {PERSON}, epoch_ms((788918400 + c_custkey % 1000 * 86400) * 1000) AS dateTime FROM customer),
auction AS (SELECT {AUCTION} FROM orders), bid AS (SELECT {BID} FROM lineitem), side_input AS (SELECT p_partkey AS key, p_brand AS value FROM part),
closed AS (SELECT a.id, a.seller, a.category, a.expires, a.dateTime AS opens, a.itemName, b.auction, b.bidder, b.price, b.dateTime AS placed, b.extra AS bid_extra
  FROM auction a JOIN bid b ON a.id = b.auction AND b.dateTime BETWEEN a.dateTime AND a.expires) """
_RANGES = {"rank1": "price < 10000", "rank2": "price >= 10000 AND price < 1000000", "rank3": "price >= 1000000"}
_BIDS = "count(*) AS total_bids, " + ", ".join(f"count(*) FILTER ({w}) AS {n}_bids" for n, w in _RANGES.items())
_DISTINCT = ", ".join(
    f"count(DISTINCT {c}) AS total_{c}s, " + ", ".join(f"count(DISTINCT {c}) FILTER ({w}) AS {n}_{c}s" for n, w in _RANGES.items()) for c in ("bidder", "auction")
)
_DAY = "strftime(dateTime, '%Y-%m-%d')"
_DEAR = "CAST(0.908 AS DECIMAL(4,3)) * CAST(price AS DECIMAL(19,0))"

SQL = {
    "q0": "SELECT auction, bidder, price, dateTime, extra FROM bid",
    "q1": f"SELECT auction, bidder, {_DEAR} AS price, dateTime, extra FROM bid",
    "q2": "SELECT auction, price FROM bid WHERE auction % 123 = 0",
    "q3": "SELECT name, city, state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE category = 10 AND state IN ('OR', 'ID', 'CA')",
    "q4": "SELECT category, CAST(sum(final) // count(*) AS BIGINT) AS mean FROM (SELECT id, category, max(price) AS final FROM closed GROUP BY ALL) GROUP BY category",
    "q5": """SELECT auction, num, window_start, window_start + INTERVAL 10 SECOND AS window_end FROM (
      SELECT *, max(num) OVER (PARTITION BY window_start) AS most FROM (
        SELECT auction, w AS window_start, count(*) AS num FROM (
          SELECT auction, unnest([time_bucket(INTERVAL 2 SECOND, dateTime) - INTERVAL 2 SECOND * i FOR i IN range(0, 5)]) AS w FROM bid) GROUP BY ALL)) WHERE num = most""",
    "q7": """SELECT auction, bidder, price, dateTime FROM (SELECT *, max(price) OVER (PARTITION BY time_bucket(INTERVAL 10 SECOND, dateTime)) AS most FROM bid) WHERE price = most""",
    "q8": """SELECT p.id, name, p.w AS window_start FROM (SELECT DISTINCT id, name, time_bucket(INTERVAL 10 SECOND, dateTime) AS w FROM person) p
      JOIN (SELECT DISTINCT seller, time_bucket(INTERVAL 10 SECOND, dateTime) AS w FROM auction) a ON p.id = a.seller AND p.w = a.w""",
    "q9": """SELECT id, itemName, seller, category, auction, bidder, price, placed FROM
      (SELECT *, row_number() OVER (PARTITION BY id ORDER BY price DESC, placed, bidder) AS rn FROM closed) WHERE rn = 1""",
    "q10": f"SELECT auction, bidder, price, dateTime, {_DAY} AS dt, strftime(dateTime, '%H:%M') AS hm FROM bid",
    "q11": """SELECT bidder, min(dateTime) AS window_start, max(dateTime) + INTERVAL 10 SECOND AS window_end, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY bidder ORDER BY dateTime, auction, price, extra ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, CASE WHEN dateTime - lag(dateTime) OVER (PARTITION BY bidder ORDER BY dateTime, auction, price, extra) <= INTERVAL 10 SECOND THEN 0 ELSE 1 END AS fresh FROM bid)) GROUP BY bidder, s""",
    "q13": "SELECT auction, bidder, price, dateTime, value FROM bid JOIN side_input ON auction % 10000 = key",
    "q14": f"""SELECT auction, bidder, dear AS price, CASE WHEN hour(dateTime) BETWEEN 8 AND 18 THEN 'dayTime' WHEN hour(dateTime) <= 6 OR hour(dateTime) >= 20 THEN 'nightTime'
      ELSE 'otherTime' END AS bidTimeType, dateTime, length(extra) - length(replace(extra, 'c', '')) AS c_counts FROM (SELECT *, {_DEAR} AS dear FROM bid) WHERE dear > 1000000 AND dear < 50000000""",
    "q15": f"SELECT {_DAY} AS day, {_BIDS}, {_DISTINCT} FROM bid GROUP BY 1",
    "q16": f"SELECT channel, {_DAY} AS day, max(strftime(dateTime, '%H:%M')) AS minute, {_BIDS}, {_DISTINCT} FROM bid GROUP BY 1, 2",
    "q17": f"""SELECT auction, {_DAY} AS day, {_BIDS}, min(price) AS min_price, max(price) AS max_price, CAST(sum(price) // count(*) AS BIGINT) AS avg_price,
      CAST(sum(price) AS BIGINT) AS sum_price FROM bid GROUP BY 1, 2""",
    "q18": "SELECT auction, bidder, price, dateTime FROM (SELECT *, row_number() OVER (PARTITION BY bidder, auction ORDER BY dateTime DESC, price DESC) AS rn FROM bid) WHERE rn = 1",
    "q19": """SELECT auction, bidder, price, dateTime, rn::INTEGER AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, dateTime, bidder) AS rn FROM bid) WHERE rn <= 10""",
    "q20": """SELECT auction, bidder, price, channel, url, b.dateTime, itemName, description, initialBid, reserve, a.dateTime AS opens, expires, seller, category
      FROM bid b JOIN auction a ON auction = id WHERE category = 10""",
    "q21": """SELECT auction, bidder, price, channel, channel_id FROM (SELECT *, CASE lower(channel) WHEN 'apple' THEN '0' WHEN 'google' THEN '1' WHEN 'facebook' THEN '2'
      WHEN 'baidu' THEN '3' ELSE nullif(regexp_extract(url, '(&|^)channel_id=([^&]*)', 2), '') END AS channel_id FROM bid) WHERE channel_id IS NOT NULL""",
    "q22": "SELECT auction, bidder, price, channel, split_part(url, '/', 4) AS dir1, split_part(url, '/', 5) AS dir2, split_part(url, '/', 6) AS dir3 FROM bid",
}

QUERIES = {f"nexmark_{name}": lambda spark, sf_dir, f=f: f(tables(spark, sf_dir)) for name, f in nexmark.ALL.items()}
ORACLES = {f"nexmark_{name}": _WITH.replace("AS STRING", "AS VARCHAR") + sql for name, sql in SQL.items()}
