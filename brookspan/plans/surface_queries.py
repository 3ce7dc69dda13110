"""Queries of sources, sinks, partitioners, user functions and descriptor plans, with SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookspan import functions as B
from brookspan.operators import aggregation, partitioning, windows
from brookspan.plans.descriptors import plan
from brookspan.plans.queries import read
from brookspan.sources import files

QUERIES: dict = {}
ORACLES: dict = {}

_LINES = "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem"


def _registered(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; without `spark.checkpoint.dir` a local one, on a local master only."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="brookspan-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_registered("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with quotes and escapes, read back by the CSV source."""
    rows, path = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), _folder(spark, "csv")
    rows.write.options(**files.DIALECT).csv(path)
    return files.read_csv(spark, path, rows.schema)


@_registered("SELECT o_orderkey, nullif(o_custkey % 5, 0) AS k FROM orders")
def source_csv_null_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null literal and a choice of columns."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.expr("nullif(o_custkey % 5, 0)").alias("k"))
    path = _folder(spark, "csv")
    rows.select("o_orderkey", "o_orderpriority", F.coalesce(F.col("k").cast("string"), F.lit("null")).alias("k")).write.options(**files.DIALECT).csv(path)
    return files.read_csv(spark, path, rows.schema, ["o_orderkey", "k"])


@_registered("SELECT o_orderstatus, o_orderkey, o_custkey FROM orders")
def sink_files_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition folders with rolled files hold every row."""
    path = _folder(spark, "files")
    rows = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_custkey")
    files.file_sink(rows, path, ["o_orderstatus"], form="parquet", rows_per_file=500)
    return spark.read.parquet(path).select("o_orderstatus", "o_orderkey", "o_custkey")


_FORMS = {
    "forward": partitioning.forward,
    "rebalance": partitioning.rebalance,
    "rescale": lambda df: partitioning.rescale(df, 2),
    "hash": lambda df: partitioning.by_key(df, ["l_orderkey"]),
    "salted": lambda df: partitioning.salted(df, ["l_returnflag"], 8).drop("salt"),
    "shuffle": lambda df: partitioning.shuffle(df, 8, 3),
}
for _name, _form in _FORMS.items():
    QUERIES[f"partition_{_name}"] = lambda spark, sf_dir, f=_form: f(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))
    ORACLES[f"partition_{_name}"] = _LINES


@_registered("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def partition_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions, five rows at every scale, go to every task."""
    regions = partitioning.broadcast(read(spark, sf_dir, "region"))
    return read(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")


@_registered("SELECT n_nationkey, n_name FROM nation")
def partition_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task; nations are 25 rows at every scale."""
    return partitioning.global_(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@_registered("SELECT o_orderkey, o_custkey * 2 + 1 AS x FROM orders")
def udf_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function over pandas series, called in SQL."""
    B.register(spark, "twice_and_one", lambda x: x * 2 + 1, "long")
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey", "twice_and_one(o_custkey) AS x")


@_registered("SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS all_users, CAST(count(DISTINCT CASE WHEN event_id % 2 = 0 THEN user_id END) AS BIGINT) AS even_users FROM events GROUP BY 1")
def agg_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.distinct_counts(read(spark, sf_dir, "events"), ["event_type"], ["user_id"], {"all": None, "even": F.col("event_id") % 2 == 0}, lambda where, _: f"{where}_users")


@_registered("SELECT o_orderkey AS f0, o_custkey % 7 AS f1 FROM orders WHERE o_custkey BETWEEN 10 AND 400")
def descriptor_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda i: {"exprType": "REFERENCE", "index": i}
    lit = lambda v: {"exprType": "LITERAL", "value": v}
    mod = {"exprType": "BINARY", "operator": "MODULUS", "left": ref(1), "right": lit(7)}
    node = {"operator": "CALC", "inputs": ["orders"], "indices": [0, mod], "condition": {"exprType": "BETWEEN", "value": ref(1), "lower": lit(10), "upper": lit(400)}}
    return plan(node, {"orders": read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")})


@_registered("SELECT o_orderkey AS f0, o_custkey AS f1, c_custkey AS f2, c_nationkey AS f3 FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey > c_custkey")
def descriptor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda i: {"exprType": "REFERENCE", "index": i}
    more = {"exprType": "BINARY", "operator": "GREATER_THAN", "left": ref(0), "right": ref(2)}
    node = {"operator": "JOIN", "inputs": ["a", "b"], "joinType": "LeftOuterJoin", "leftJoinKey": [1], "rightJoinKey": [0], "nonEquiCondition": more}
    return plan(node, {"a": read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "b": read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")})


@_registered("SELECT user_id AS f0, count(*) AS f1, max(event_id) AS f2 FROM events GROUP BY 1")
def descriptor_group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = {"operator": "GROUP_AGGREGATE", "inputs": ["e"], "grouping": [0], "aggregateCalls": [{"name": "COUNT"}, {"name": "MAX", "argIndexes": [1]}]}
    return plan(node, {"e": read(spark, sf_dir, "events").select("user_id", "event_id")})


@_registered("SELECT user_id, event_id, CAST(event_id AS VARCHAR) AS \"window\", time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events")
def win_beside_a_column_named_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_id").cast("string").alias("window"))
    return windows.tumble(rows, "ts", "1 hour").select("user_id", "event_id", "window", "window_start")


@_registered("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"a":1}' ELSE '[1,2]' END AS text, CAST(NULL AS VARCHAR) AS nested, '{"x":[' || event_id || ']}' AS whole FROM events""")
def fn_json_text_that_looks_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that holds JSON is a scalar."""
    text = F.when(F.col("event_id") % 2 == 0, '{"a":1}').otherwise("[1,2]")
    inner = F.struct(F.array(F.col("event_id")).alias("x"))
    rows = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(text.alias("s"), inner.alias("o"))).alias("j"))
    return rows.select("event_id", B.json_value("j", "$.s").alias("text"), B.json_query("j", "$.s").alias("nested"), B.json_query("j", "$.o").alias("whole"))
