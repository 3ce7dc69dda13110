"""One query for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brookspan import functions as B
from brookspan.operators import aggregation, calc, changelog, joins, ranking, sets, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(*tables: str, sql: str | None = None):
    """Registers a function of tables under its name."""

    def register(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(*(read(spark, sf_dir, t) for t in tables))
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def cents(name: str):
    """A double amount as whole hundredths."""
    return F.round(F.col(name) * 100).cast("bigint")


# --- projection, filter, expansion -------------------------------------------------------------------------------------

@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
  CAST(round(l_extendedprice * 100) AS BIGINT) * 2 - l_linenumber AS twice FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'R'""")
def calc_project_filter(lineitem):
    return calc.calc(
        lineitem,
        {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "price": cents("l_extendedprice"), "twice": cents("l_extendedprice") * 2 - F.col("l_linenumber")},
        "l_quantity >= 30 AND l_returnflag = 'R'",
    )


@query("orders", sql="SELECT o_orderkey, o_custkey % 7 AS m, -o_custkey % 7 AS n, o_custkey // 7 AS q, -o_custkey // 7 AS r FROM orders")
def calc_arith_mod(orders):
    key = F.col("o_custkey")
    return calc.calc(orders, {"o_orderkey": "o_orderkey", "m": B.mod(key, F.lit(7)), "n": B.mod(-key, F.lit(7)), "q": B.divide(key, F.lit(7)), "r": B.divide(-key, F.lit(7))})


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 OR l_quantity <= 8 THEN 'edge' ELSE 'middle' END AS part
  FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 AND l_returnflag IN ('A', 'N')""")
def calc_case_between_in(lineitem):
    part = F.when((F.col("l_quantity") >= 40) | (F.col("l_quantity") <= 8), "edge").otherwise("middle")
    return calc.calc(lineitem, {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "part": part}, "l_linenumber BETWEEN 2 AND 4 AND l_returnflag IN ('A', 'N')")


@query("customer", sql="SELECT c_custkey, nullif(c_nationkey % 5, 0) AS n FROM customer WHERE nullif(c_nationkey % 5, 0) > 1")
def calc_null_condition(customer):
    return calc.calc(customer.withColumn("n", F.expr("nullif(c_nationkey % 5, 0)")), {"c_custkey": "c_custkey", "n": "n"}, F.col("n") > 1)


@query("lineitem", sql="""SELECT l_orderkey, 0 AS side, l_partkey AS k FROM lineitem
  UNION ALL SELECT l_orderkey, 1, l_suppkey FROM lineitem""")
def expand_projections(lineitem):
    return calc.expand(lineitem, [{"l_orderkey": F.col("l_orderkey"), "side": F.lit(i), "k": F.col(c)} for i, c in enumerate(("l_partkey", "l_suppkey"))])


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, 0 AS side, l_partkey AS k FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 1, l_suppkey FROM lineitem""")
def expand_projections_whole(lineitem):
    return calc.expand(lineitem, [{"l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber"), "side": F.lit(i), "k": F.col(c)} for i, c in enumerate(("l_partkey", "l_suppkey"))])


def _sums():
    return {"n": B.count(), "price": F.sum(cents("l_extendedprice"))}


_SUMS_SQL = "count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price"


@query("lineitem", sql=f"SELECT l_returnflag, l_linestatus, l_linenumber, {_SUMS_SQL} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def expand_grouping_sets(lineitem):
    return calc.grouping_sets(lineitem, [["l_returnflag", "l_linestatus"], ["l_linenumber"], []], _sums())


@query("lineitem", sql=f"SELECT l_returnflag, l_linestatus, {_SUMS_SQL} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def expand_cube(lineitem):
    return calc.cube(lineitem, ["l_returnflag", "l_linestatus"], _sums())


@query("lineitem", sql=f"SELECT l_returnflag, l_linestatus, {_SUMS_SQL} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def expand_rollup(lineitem):
    return calc.rollup(lineitem, ["l_returnflag", "l_linestatus"], _sums())


@query("events", sql="SELECT event_id, user_id * 2 AS twice FROM events")
def stream_map(events):
    return calc.map_rows(events.select("event_id", "user_id"), lambda f: f.assign(twice=f.user_id * 2)[["event_id", "twice"]], "event_id long, twice long")


@query("events", sql="SELECT event_id, user_id FROM events WHERE user_id % 3 = 1")
def stream_filter(events):
    return calc.filter_rows(events.select("event_id", "user_id"), lambda f: f.user_id % 3 == 1)


@query("events", sql="SELECT event_id, unnest(range(0, event_id % 3)) AS i FROM events")
def stream_flat_map(events):
    def copies(frame):
        out = frame.loc[frame.index.repeat(frame.event_id % 3)]
        return out.assign(i=out.groupby("event_id").cumcount().astype("int64"))

    return calc.flat_map(events.select("event_id"), copies, "event_id long, i long")


@query("events", sql="SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'other' END AS side FROM events")
def side_split(events):
    even, other = calc.side_split(events, F.col("user_id") % 2 == 0)
    return even.select("event_id", F.lit("even").alias("side")).union(other.select("event_id", F.lit("other").alias("side")))


# --- scalar functions --------------------------------------------------------------------------------------------------

@query("pages", sql="SELECT page_id, nullif(split_part(url, '/', 3), '') AS host, nullif(split_part(url, '/', 5), '') AS last, CAST(NULL AS VARCHAR) AS none FROM pages")
def fn_split_index(pages):
    nothing = lambda x: F.when(x != "", x)
    return pages.select("page_id", nothing(B.split_index("url", "/", 2)).alias("host"), nothing(B.split_index("url", "/", 4)).alias("last"), B.split_index("url", "/", 99).alias("none"))


@query("part", sql="SELECT p_partkey, length(p_name) - length(replace(p_name, 'a', '')) AS n FROM part")
def fn_count_char(part):
    return part.select("p_partkey", B.count_char("p_name", "a").alias("n"))


@query("pages", sql="SELECT page_id, nullif(regexp_extract(url, '//([a-z]+)[.]', 1), '') AS host, nullif(regexp_extract(url, 'page=(\\d+)', 1), '') AS number FROM pages")
def fn_regex_extract(pages):
    return pages.select("page_id", B.regex_extract("url", "//([a-z]+)[.]").alias("host"), B.regex_extract("url", r"page=(\d+)").alias("number"))


@query("part", sql="SELECT p_partkey, lower(p_name) AS name, length(p_type) AS n, coalesce(nullif(p_brand, 'Brand#13'), 'none') AS brand FROM part")
def fn_lower_charlen_coalesce(part):
    return part.select("p_partkey", B.lower("p_name").alias("name"), B.char_length("p_type").cast("bigint").alias("n"), B.coalesce(F.expr("nullif(p_brand, 'Brand#13')"), F.lit("none")).alias("brand"))


@query("events", sql="SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def fn_json_value(events):
    return events.select("event_id", B.json_value("props", "$.k").alias("k"), B.json_value("props", "$.none").alias("missing"))


@query("events", sql="SELECT event_id, '{\"k\":[' || event_id || ',2]}' AS whole, '[' || event_id || ',2]' AS list, CAST(event_id AS VARCHAR) AS first FROM events")
def fn_json_query(events):
    text = F.format_string('{"a": {"k":[%d,2]}, "b": [%d, 3]}', "event_id", "event_id")
    rows = events.select("event_id", text.alias("j"))
    return rows.select("event_id", B.json_query("j", "$.a").alias("whole"), B.json_query("j", "$.a.k").alias("list"), B.json_value("j", "$.b[0]").alias("first"))


@query("events", sql="SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS clock, hour(ts) AS h FROM events")
def fn_date_format_hour(events):
    return events.select("event_id", B.date_format("ts", "yyyy-MM-dd").alias("day"), B.date_format("ts", "HH:mm").alias("clock"), B.hour("ts").alias("h"))


@query("events", sql="SELECT event_id, epoch_ms(event_id * 1001) AS ms, epoch_ms(event_id * 1000) AS s FROM events")
def fn_to_timestamp_ltz(events):
    key = F.col("event_id")
    return events.select("event_id", B.to_timestamp_ltz(key * 1001, 3).cast("timestamp_ntz").alias("ms"), B.to_timestamp_ltz(key).cast("timestamp_ntz").alias("s"))


@query("events")
def fn_proctime(events):
    return events.select("event_id", B.proctime().alias("at"))


@query("events")
def fn_hash_code(events):
    return events.select("event_id", B.hash_code("user_id").alias("code"))


# --- aggregation -------------------------------------------------------------------------------------------------------

@query("lineitem", sql="""SELECT l_returnflag, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, min(v) AS low, max(v) AS high, CAST(sum(v) // count(v) AS BIGINT) AS mean
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem) GROUP BY l_returnflag""")
def agg_count_sum_min_max_avg(lineitem):
    rows = lineitem.withColumn("v", cents("l_extendedprice"))
    return aggregation.group_agg(rows, ["l_returnflag"], {"n": B.count(), "s": B.sum_("v"), "low": B.min_("v"), "high": B.max_("v"), "mean": B.avg("v")})


@query("lineitem", sql="""SELECT l_suppkey, count(*) FILTER (l_quantity < 10) AS few, count(*) FILTER (l_quantity >= 10 AND l_quantity < 30) AS some,
  CAST(sum(l_linenumber) FILTER (l_returnflag = 'R') AS BIGINT) AS returned FROM lineitem GROUP BY l_suppkey""")
def agg_filter(lineitem):
    q = F.col("l_quantity")
    return aggregation.group_agg(lineitem, ["l_suppkey"], {"few": B.count(where=q < 10), "some": B.count(where=(q >= 10) & (q < 30)), "returned": B.sum_("l_linenumber", where=F.col("l_returnflag") == "R")})


@query("lineitem", sql="SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) FILTER (l_quantity > 25) AS parts FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(lineitem):
    return aggregation.group_agg(lineitem, ["l_returnflag"], {"suppliers": B.count_distinct("l_suppkey"), "parts": B.count_distinct("l_partkey", where=F.col("l_quantity") > 25)})


def _changelog(events):
    """Every fifth event takes back the one before it."""
    back = F.when(F.col("event_id") % 5 == 4, F.col("event_id") - 1).otherwise(F.col("event_id"))
    by_id = Window.partitionBy(F.floor(F.col("event_id") / 5)).orderBy("event_id")
    user, value = (F.lag(c).over(by_id) for c in ("user_id", "v"))
    rows = events.withColumn("v", cents("value"))
    taken = F.col("event_id") % 5 == 4
    return rows.select(F.when(taken, user).otherwise(F.col("user_id")).alias("user_id"), F.when(taken, value).otherwise(F.col("v")).alias("v"), back.alias("id"), F.when(taken, "-D").otherwise("+I").alias("row_kind"))


_LEFT_SQL = "(SELECT user_id, event_id AS id, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE event_id % 5 < 3 OR event_id % 5 = 3 AND event_id = (SELECT max(event_id) FROM events))"


@query("events", sql=f"SELECT user_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v) // count(*) AS BIGINT) AS mean FROM {_LEFT_SQL} GROUP BY user_id")
def agg_retract_weighted(events):
    w = changelog.weight()
    return aggregation.weighted_agg(_changelog(events), ["user_id"], {"n": B.count(weight=w), "s": B.sum_("v", weight=w), "mean": B.avg("v", weight=w)})


@query("events", sql=f"SELECT user_id, min(v) AS low, max(v) AS high, count(DISTINCT v) AS kinds FROM {_LEFT_SQL} GROUP BY user_id")
def agg_retract_min_max_distinct(events):
    return aggregation.group_agg(_changelog(events), ["user_id"], {"low": B.min_("v"), "high": B.max_("v"), "kinds": B.count_distinct("v")}, row_kind="row_kind")


@query("part", sql="SELECT p_brand, min(p_name) AS low, max(p_name) AS high FROM part GROUP BY p_brand")
def agg_minmax_varchar(part):
    return aggregation.group_agg(part, ["p_brand"], {"low": B.min_("p_name"), "high": B.max_("p_name")})


@query("events", sql="SELECT min(ts) AS low, max(ts) AS high, count(*) AS n FROM events")
def agg_global(events):
    return aggregation.group_agg(events, [], {"low": B.min_("ts"), "high": B.max_("ts"), "n": B.count()})


@query("events", sql="SELECT user_id, arg_max(x, event_id) FILTER (x IS NOT NULL) AS last FROM (SELECT *, nullif(event_type, 'view') AS x FROM events) GROUP BY user_id")
def agg_last_value(events):
    return aggregation.group_agg(events.withColumn("x", F.expr("nullif(event_type, 'view')")), ["user_id"], {"last": B.last_value("x", "event_id")})


@query("events", sql="SELECT event_id, user_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM events")
def reduce_running(events):
    return aggregation.running(events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], {"so_far": F.sum("event_id")}).drop("ts")


@query("events", sql="SELECT user_id, event_id AS seq, CAST(max(event_id % 97) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS most FROM events")
def reduce_user_function(events):
    rows = events.select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 97).alias("most"))
    return aggregation.reduce_running(rows, ["user_id"], ["seq"], lambda a, b: {**b, "most": max(a["most"], b["most"])})


# --- windows -----------------------------------------------------------------------------------------------------------

_EVENTS = "(SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
_AGGS_SQL = "count(*) AS n, CAST(sum(v) AS BIGINT) AS s, min(v) AS low, max(v) AS high, CAST(sum(v) // count(v) AS BIGINT) AS mean"


def _aggs():
    return {"n": B.count(), "s": B.sum_("v"), "low": B.min_("v"), "high": B.max_("v"), "mean": B.avg("v")}


def _parts():
    return {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v")), "mean": ("avg", F.col("v"))}


def _valued(events):
    return events.withColumn("v", cents("value"))


@query("events", sql=f"SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, {_AGGS_SQL} FROM {_EVENTS} GROUP BY 1, 2")
def win_tumble(events):
    return windows.window_agg(windows.tumble(_valued(events), "ts", "1 hour"), ["user_id"], _aggs())


@query("events", sql=f"""SELECT event_type, b AS window_start, b + INTERVAL '1 day' AS window_end, {_AGGS_SQL}
  FROM (SELECT *, time_bucket(INTERVAL '1 day', ts - INTERVAL '3 hours') + INTERVAL '3 hours' AS b FROM {_EVENTS}) GROUP BY event_type, b""")
def win_tumble_offset(events):
    return windows.window_agg(windows.tumble(_valued(events), "ts", "1 day", "3 hours"), ["event_type"], _aggs())


@query("events", sql=f"""SELECT event_type, b AS window_start, b + INTERVAL '1 day' AS window_end, {_AGGS_SQL}
  FROM (SELECT *, time_bucket(INTERVAL '1 day', ts - INTERVAL '5 hours') + INTERVAL '5 hours' AS b FROM {_EVENTS}) GROUP BY event_type, b""")
def win_tumble_zone(events):
    """Days of a place five hours behind UTC."""
    return windows.window_agg(windows.tumble(_valued(events), "ts", "1 day", zone="-05:00"), ["event_type"], _aggs()).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


_HOP_SQL = f"""SELECT user_id, w AS window_start, w + INTERVAL '1 hour' AS window_end, {_AGGS_SQL}
  FROM (SELECT *, unnest([time_bucket(INTERVAL '20 minutes', ts) - INTERVAL '20 minutes' * i FOR i IN range(0, 3)]) AS w FROM {_EVENTS}) GROUP BY user_id, w"""


@query("events", sql=_HOP_SQL)
def win_hop(events):
    return windows.window_agg(windows.hop(_valued(events), "ts", "1 hour", "20 minutes"), ["user_id"], _aggs())


@query("events", sql=_HOP_SQL)
def win_hop_shared_slices(events):
    return windows.hop_agg(_valued(events), ["user_id"], "ts", "1 hour", "20 minutes", _parts())


_CUMULATE_SQL = f"""SELECT event_type, d AS window_start, e AS window_end, {_AGGS_SQL}
  FROM (SELECT *, unnest([b + INTERVAL '1 hour' * i FOR i IN range(1, 1 + CAST(date_diff('hour', b, d + INTERVAL '1 day') AS BIGINT))]) AS e
        FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS b, date_trunc('day', ts)::TIMESTAMP AS d FROM {_EVENTS})) GROUP BY event_type, d, e"""


@query("events", sql=_CUMULATE_SQL)
def win_cumulate(events):
    return windows.cumulate_agg(_valued(events), ["event_type"], "ts", "1 day", "1 hour", _parts())


@query("events", sql=_CUMULATE_SQL)
def win_cumulate_rows(events):
    return windows.window_agg(windows.cumulate(_valued(events), "ts", "1 day", "1 hour"), ["event_type"], _aggs())


@query("events", sql=f"""SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '30 minutes' AS window_end, {_AGGS_SQL}
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s_no
        FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM {_EVENTS}))
  GROUP BY user_id, s_no""")
def win_session(events):
    return windows.session_agg(_valued(events), ["user_id"], "ts", "30 minutes", _aggs())


@query("events", sql="SELECT time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' - INTERVAL '1 millisecond' AS rowtime, count(*) AS n FROM events GROUP BY 1")
def win_rowtime(events):
    found = windows.window_agg(windows.tumble(events, "ts", "1 hour"), [], {"n": B.count()})
    return found.select(B.window_rowtime("window_end").alias("rowtime"), "n")


@query("events", sql="""SELECT window_end, max(n) AS most FROM (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def win_of_windowed_input(events):
    first = windows.window_agg(windows.tumble(events, "ts", "1 hour"), ["event_type"], {"n": B.count()})
    return windows.window_agg(first, [], {"most": B.max_("n")}).drop("window_start")


# --- ranking and deduplication -----------------------------------------------------------------------------------------

_RANKED = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h {0}, event_id {1}) AS rn FROM (SELECT event_id, user_id, date_trunc('hour', ts)::TIMESTAMP AS h FROM events))"


def _hours(events):
    return events.select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"))


@query("events", sql=f"SELECT event_id, user_id, h FROM {_RANKED.format('', '')} WHERE rn = 1")
def dedup_first(events):
    return ranking.deduplicate(_hours(events), ["user_id"], "h", "first", "event_id")


@query("events", sql=f"SELECT event_id, user_id, h FROM {_RANKED.format('DESC', 'DESC')} WHERE rn = 1")
def dedup_last(events):
    return ranking.deduplicate(_hours(events), ["user_id"], "h", "last", "event_id")


@query("events", sql=f"SELECT event_id, user_id, h, rn::INTEGER AS rank FROM {_RANKED.format('DESC', '')} WHERE rn <= 5")
def topn_rank(events):
    return ranking.top_n(_hours(events), ["user_id"], [("h", False)], 5, seq="event_id")


@query("events", sql=f"SELECT event_id, user_id, h FROM {_RANKED.format('', '')} WHERE rn <= 3")
def topn_norank(events):
    return ranking.top_n(_hours(events), ["user_id"], [("h", True)], 3, seq="event_id", rank=None)


@query("events", sql=f"SELECT event_id, user_id, h, rn::INTEGER AS rank FROM {_RANKED.format('', '')} WHERE rn BETWEEN 3 AND 6")
def topn_offset(events):
    return ranking.top_n(_hours(events), ["user_id"], [("h", True)], 6, start=3, seq="event_id")


@query("events", sql=f"SELECT event_id, user_id, h, rn::INTEGER AS rank FROM {_RANKED.format('', '')} WHERE rn <= 1 + user_id % 3")
def topn_variable(events):
    return ranking.top_n(_hours(events), ["user_id"], [("h", True)], 1 + F.col("user_id") % 3, seq="event_id")


@query("orders", sql="""SELECT o_custkey, o_orderkey, o_orderpriority FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def top1_two_keys(orders):
    return ranking.top_1(orders, ["o_custkey"], [("o_orderpriority", True), ("o_orderdate", False)], seq="o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("events", sql="""SELECT event_id, user_id, x FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x NULLS FIRST, event_id) AS rn
  FROM (SELECT event_id, user_id, nullif(event_id % 4, 1) AS x FROM events)) WHERE rn <= 2""")
def topn_nulls_first(events):
    rows = events.select("event_id", "user_id", F.expr("nullif(event_id % 4, 1)").alias("x"))
    return ranking.top_n(rows, ["user_id"], [("x", True)], 2, seq="event_id", rank=None, nulls_last=False)


@query("events", sql="SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_id % 3 <> 0")
def changelog_materialize(events):
    kind = F.when(F.col("event_id") % 3 == 0, "-D").otherwise("+U")
    rows = events.select("user_id", "event_type", "event_id", F.col("event_id").alias("seq"), kind.alias("row_kind"))
    return changelog.materialize(rows, ["user_id", "event_type"], "seq")


@query("events", sql="""SELECT user_id, seq, kind AS row_kind, x FROM (
  SELECT user_id, seq, CASE WHEN b IS NULL THEN '+I' ELSE '+U' END AS kind, x FROM c WHERE b IS NULL OR b <> x
  UNION ALL SELECT user_id, seq, '-U', b FROM c WHERE b <> x)""".replace("FROM c", "FROM (SELECT user_id, event_id AS seq, event_id % 4 AS x, lag(event_id % 4) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)"))
def changelog_of_upserts(events):
    return changelog.changes(events.select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("x")), ["user_id"], "seq")


# --- joins -------------------------------------------------------------------------------------------------------------

def _regular(how: str, kind: str):
    columns = "o_orderkey, o_custkey" + ("" if how in ("left_semi", "left_anti") else ", c_custkey, c_nationkey")

    def run(orders, customer):
        found = joins.join(orders.select("o_orderkey", "o_custkey"), customer.select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")], how)
        return found.select(*columns.split(", "))

    run.__name__ = "join_" + how.removeprefix("left_" if how != "left" else "")
    query("orders", "customer", sql=f"SELECT {columns} FROM orders {kind} JOIN customer ON o_custkey = c_custkey")(run)


for _how, _kind in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("left_semi", "SEMI"), ("left_anti", "ANTI")):
    _regular(_how, _kind)


# The same joins with a key that is null for some rows, which leaves these unmatched.
_ALL_ORDERS = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS a FROM orders)"
_ALL_CUSTOMERS = "(SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 <> 0 THEN c_custkey END AS b FROM customer)"


def _whole(how: str, kind: str):
    columns = "o_orderkey, o_custkey" + ("" if how in ("left_semi", "left_anti") else ", c_custkey, c_nationkey")

    def run(orders, customer):
        left = orders.select("o_orderkey", "o_custkey", F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END").alias("a"))
        right = customer.select("c_custkey", "c_nationkey", F.expr("CASE WHEN c_custkey % 2 <> 0 THEN c_custkey END").alias("b"))
        return joins.join(left, right, [("a", "b")], how).select(*columns.split(", "))

    run.__name__ = "join_whole_" + how.removeprefix("left_" if how != "left" else "")
    query("orders", "customer", sql=f"SELECT {columns} FROM {_ALL_ORDERS} x {kind} JOIN {_ALL_CUSTOMERS} y ON a = b")(run)


for _how, _kind in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("left_semi", "SEMI"), ("left_anti", "ANTI")):
    _whole(_how, _kind)


@query("orders", "lineitem", sql="""SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAYS""")
def join_nonequi_range(orders, lineitem):
    between = lineitem.l_shipdate.between(orders.o_orderdate, orders.o_orderdate + F.expr("INTERVAL 30 DAYS"))
    return joins.join(orders, lineitem, [("o_orderkey", "l_orderkey")], condition=between).select("o_orderkey", "l_linenumber")


_NULLS = "(SELECT {0} AS {1}, nullif({2} % 5, 0) AS {3} FROM {4})"


def _nulls(customer, supplier):
    return (
        customer.select("c_custkey", F.expr("nullif(c_nationkey % 5, 0)").alias("a")),
        supplier.select("s_suppkey", F.expr("nullif(s_nationkey % 5, 0)").alias("b")),
    )


_NULL_SIDES = f"{_NULLS.format('c_custkey', 'c_custkey', 'c_nationkey', 'a', 'customer')} x {{0}} JOIN {_NULLS.format('s_suppkey', 's_suppkey', 's_nationkey', 'b', 'supplier')} y ON {{1}}"


@query("customer", "supplier", sql="SELECT c_custkey, s_suppkey FROM " + _NULL_SIDES.format("LEFT", "a = b"))
def join_null_keys(customer, supplier):
    return joins.join(*_nulls(customer, supplier), [("a", "b")], "left", many_pairs=True).select("c_custkey", "s_suppkey")


@query("customer", "supplier", sql="SELECT c_custkey, s_suppkey FROM " + _NULL_SIDES.format("INNER", "a IS NOT DISTINCT FROM b"))
def join_null_safe(customer, supplier):
    return joins.join(*_nulls(customer, supplier), [("a", "b")], null_safe=True, many_pairs=True).select("c_custkey", "s_suppkey")


_SIDES_SQL = """(SELECT user_id, event_id, time_bucket(INTERVAL '1 hour', ts) AS w FROM events WHERE event_type = 'click') a {0} JOIN
  (SELECT user_id AS u, event_id AS e, time_bucket(INTERVAL '1 hour', ts) AS v FROM events WHERE event_type = 'view') b ON user_id = u AND w = v {1}"""


def _window_sides(events):
    rows = windows.tumble(events.select("user_id", "event_id", "event_type", "ts"), "ts", "1 hour").drop("ts")
    right = rows.where("event_type = 'view'").select(
        F.col("user_id").alias("u"), F.col("event_id").alias("e"), F.col("window_start").alias("right_window_start"), F.col("window_end").alias("right_window_end")
    )
    return rows.where("event_type = 'click'").drop("event_type"), right


def _windowed(how: str, kind: str):
    one_side = how in ("left_semi", "left_anti")
    columns = "user_id, event_id" + ("" if one_side else ", e")

    def run(events):
        left, right = _window_sides(events)
        return joins.window_join(left, right, [("user_id", "u")], how).select(*columns.split(", "))

    run.__name__ = "wjoin_" + how.removeprefix("left_" if one_side else "")
    query("events", sql=f"SELECT {columns} FROM {_SIDES_SQL.format(kind, '')}")(run)


for _how, _kind in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("left_semi", "SEMI"), ("left_anti", "ANTI")):
    _windowed(_how, _kind)


@query("events", sql=f"SELECT user_id, event_id, e FROM {_SIDES_SQL.format('INNER', 'AND event_id < e')}")
def wjoin_nonequi(events):
    left, right = _window_sides(events)
    return joins.window_join(left, right, [("user_id", "u")], condition=left.event_id < right.e).select("user_id", "event_id", "e")


@query("lineitem", "part", sql="SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 20")
def lookup_inner(lineitem, part):
    return joins.lookup_join(lineitem, part.where("p_size > 20"), ("l_partkey", "p_partkey"), selected=["p_brand"]).select("l_orderkey", "l_linenumber", "p_brand")


@query("lineitem", "part", sql="SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON l_partkey = p_partkey")
def lookup_left(lineitem, part):
    return joins.lookup_join(lineitem, part.where("p_size > 20"), ("l_partkey", "p_partkey"), "left", ["p_brand"]).select("l_orderkey", "l_linenumber", "p_brand")


# --- set operations ----------------------------------------------------------------------------------------------------

@query("customer", "supplier", sql="SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(customer, supplier):
    return sets.union_all(customer.select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k")))


@query("customer", "supplier", sql="SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(customer, supplier):
    return sets.union_distinct(customer.select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k")))


@query("customer", "supplier", sql="SELECT c_custkey % 40 AS k FROM customer INTERSECT SELECT s_nationkey + 20 FROM supplier")
def intersect(customer, supplier):
    return sets.intersect(customer.select((F.col("c_custkey") % 40).alias("k")), supplier.select((F.col("s_nationkey") + 20).alias("k")))


@query("customer", "supplier", sql="SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_whole(customer, supplier):
    return sets.intersect(customer.select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k")))


@query("customer", "supplier", sql="SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(customer, supplier):
    return sets.except_(customer.select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k")), all_=True)


@query("orders", sql="SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10")
def sort_limit(orders):
    return sets.sort_limit(orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 10)


# --- the slice through everything ---------------------------------------------------------------------------------------

@query("orders", "lineitem", sql="""SELECT o_orderpriority, CAST(sum(m) // count(m) AS BIGINT) AS mean, count(*) AS n FROM (
  SELECT o_orderkey, o_orderpriority, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS m FROM orders JOIN lineitem
  ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAYS GROUP BY 1, 2) GROUP BY 1""")
def flagship(orders, lineitem):
    """The mean over orders of their dearest line shipped within 30 days, by priority."""
    left = calc.calc(orders, {"o_orderkey": "o_orderkey", "o_orderpriority": "o_orderpriority", "o_orderdate": "o_orderdate"})
    right = calc.calc(lineitem, {"l_orderkey": "l_orderkey", "l_shipdate": "l_shipdate", "price": cents("l_extendedprice")})
    between = right.l_shipdate.between(left.o_orderdate, left.o_orderdate + F.expr("INTERVAL 30 DAYS"))
    joined = joins.join(left, right, [("o_orderkey", "l_orderkey")], condition=between)
    dearest = aggregation.group_agg(joined, ["o_orderkey", "o_orderpriority"], {"m": B.max_("price")})
    return aggregation.group_agg(dearest, ["o_orderpriority"], {"mean": B.avg("m"), "n": B.count()})
