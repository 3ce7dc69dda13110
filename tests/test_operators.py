"""Edge cases of the relational operators on small tables."""

import datetime as dt

import pytest
from brookspan import functions as B
from brookspan.operators import aggregation, calc, changelog, joins, partitioning, ranking, sets, windows
from brookspan.plans import queries
from brookspan.types import schema, spark_type
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("BIGINT NOT NULL", T.LongType()), ("INTEGER", T.IntegerType()), ("TINYINT", T.ByteType()), ("FLOAT", T.FloatType()), ("VARCHAR(20)", T.StringType()),
        ("DECIMAL(38, 2)", T.DecimalType(38, 2)), ("TIMESTAMP(3) *ROWTIME*", T.TimestampNTZType()), ("TIMESTAMP_LTZ(3)", T.TimestampType()),
        ("TIMESTAMP(3) WITH LOCAL TIME ZONE", T.TimestampType()), ("TIME", T.LongType()), ("INTERVAL YEAR TO MONTH", T.YearMonthIntervalType()),
        ("INTERVAL DAY", T.DayTimeIntervalType()), ("ARRAY<INT>", T.ArrayType(T.IntegerType())), ("MAP<STRING, BIGINT>", T.MapType(T.StringType(), T.LongType())),
        ("MULTISET<STRING>", T.MapType(T.StringType(), T.IntegerType())), ("ROW<a INT, b DECIMAL(5, 1)>", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DecimalType(5, 1))])),
    ],
)
def test_type_names(name, wanted):
    assert spark_type(name) == wanted


def test_unknown_type_and_schema():
    with pytest.raises(ValueError, match="unknown type"):
        spark_type("NONSENSE")
    assert not schema({"a": "BIGINT NOT NULL"})["a"].nullable


def test_scalar_functions(spark):
    json = '{"id": 721, "user": {"name": "Alice", "tags": ["a", "b", "c"]}, "scores": [79.39], "none": null}'
    df = spark.createDataFrame([("a|b||d", json, "channel_id=12x", -7)], "s string, j string, u string, n long")
    one = df.select(
        B.split_index("s", "|", 1).alias("a"), B.split_index("s", "|", 2).alias("b"), B.split_index("s", "|", 9).alias("c"), B.split_index("s", "|", -1).alias("d"),
        B.count_char("s", "|").alias("e"), B.json_value("j", "$.id").alias("f"), B.json_value("j", "$.user").alias("g"), B.json_value("j", "$.user.tags[2]").alias("h"),
        B.json_query("j", "$.user.tags").alias("i"), B.json_query("j", "$.id").alias("k"), B.json_value("j", "$.scores[0]").alias("l"), B.json_value("j", "$.none").alias("m"),
        B.regex_extract("u", r"channel_id=(\d+)", 1).alias("o"), B.regex_extract("u", "nope(.)", 1).alias("p"), B.divide("n", F.lit(2)).alias("q"), B.mod("n", F.lit(3)).alias("r"),
    ).first()
    assert tuple(one) == ("b", "", None, None, 3, "721", None, "c", '["a","b","c"]', None, "79.39", None, "12", None, -3, -1)


def test_user_function_in_sql(spark):
    B.register(spark, "plus_one", lambda x: x + 1, "long")
    assert spark.sql("SELECT plus_one(41) AS x").first().x == 42


def test_condition_that_is_null_drops_the_row(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert rows(calc.calc(df, {"x": "x"}, "x > 0")) == [(1,)]
    yes, no = calc.side_split(df, F.col("x") > 0)
    assert (yes.count(), no.count()) == (1, 1)


def test_expand_needs_equal_columns(spark):
    with pytest.raises(ValueError):
        calc.expand(spark.range(1), [{"a": F.lit(1)}, {"b": F.lit(1)}])


def test_count_of_nulls_is_zero_and_sum_null(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "k int, v long")
    assert rows(aggregation.group_agg(df, ["k"], {"c": B.count("v"), "s": B.sum_("v"), "a": B.avg("v")})) == [(1, 0, None, None)]


def test_average_is_cut_towards_zero(spark):
    df = spark.createDataFrame([(-3,), (-4,)], "v long")
    assert rows(aggregation.group_agg(df, [], {"a": B.avg("v")})) == [(-3,)]


def test_retracted_group_is_gone(spark):
    df = spark.createDataFrame([("a", 1, "+I"), ("a", 1, "-D"), ("b", 5, "+I"), ("b", 9, "+I"), ("b", 9, "-U")], "k string, v long, row_kind string")
    assert rows(aggregation.group_agg(df, ["k"], {"n": B.count(), "hi": B.max_("v")}, "row_kind")) == [("b", 1, 5)]
    w = changelog.weight()
    assert rows(aggregation.weighted_agg(df, ["k"], {"n": B.count(weight=w), "s": B.sum_("v", weight=w)})) == [("b", 1, 5)]


def test_netted_keeps_duplicates(spark):
    df = spark.createDataFrame([(1, "+I"), (1, "+I"), (1, "-D"), (1, "+U"), (2, "-D")], "x int, row_kind string")
    assert rows(changelog.netted(df)) == [(1,), (1,)]


def test_touching_sessions_merge(spark):
    times = [0, 10, 21]
    df = spark.createDataFrame([(t,) for t in times], "s long").select(F.timestamp_seconds("s").alias("t"))
    assert rows(windows.session_agg(df, [], "t", "10 seconds", {"n": B.count()}).select("n")) == [(1,), (2,)]


def test_windows_before_the_epoch_and_offset(spark):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59, 57),)], "t timestamp_ntz")
    one = windows.tumble(df, "t", "10 seconds", "3 seconds").first()
    assert one.window_start == dt.datetime(1969, 12, 31, 23, 59, 53)


def test_cumulate_sizes(spark):
    with pytest.raises(ValueError):
        windows.cumulate(spark.range(1).select(F.current_timestamp().alias("t")), "t", "10 seconds", "3 seconds")


def test_shared_hop_equals_plain_hop_when_slide_does_not_divide(spark):
    df = spark.range(200).select(F.timestamp_seconds(F.col("id") * 7).alias("t"), (F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    shared = windows.hop_agg(df, ["k"], "t", "60 seconds", "25 seconds", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "a": ("avg", F.col("v"))})
    plain = windows.window_agg(windows.hop(df, "t", "60 seconds", "25 seconds"), ["k"], {"n": B.count(), "s": B.sum_("v"), "a": B.avg("v")})
    assert rows(shared.select(*sorted(plain.columns))) == rows(plain.select(*sorted(plain.columns)))


def test_ties(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 4, 3)], "k int, v int, seq int")
    assert rows(ranking.top_1(df, ["k"], [("v", False)], "seq")) == [(1, 5, 1)]
    assert rows(ranking.deduplicate(df, ["k"], "v", "last", "seq")) == [(1, 5, 2)]
    assert rows(ranking.deduplicate(df, ["k"], "v", "first", "seq")) == [(1, 4, 3)]
    with pytest.raises(ValueError):
        ranking.top_n(df, [], [("v", True)], 1)


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = ranking.top_n(df, ["k"], [("id", True)], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_lookup_is_broadcast_only_while_small(spark, monkeypatch):
    a, b = spark.range(10).withColumnRenamed("id", "x"), spark.range(10)
    plan = lambda: joins.lookup_join(a, b, ("x", "id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(joins, "LOOKUP_BYTES", 1)
    assert "broadcast" not in plan()


def test_duplicate_lookup_keys_give_all_rows(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "y int, v string")
    assert rows(joins.lookup_join(a, b, ("x", "y"), "left").select("x", "v")) == [(1, "p"), (1, "q"), (2, None), (None, None)]


def test_set_operations(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,)], "x int")
    assert rows(sets.except_(a, b, all_=True)) == [(1,), (2,)]
    assert rows(sets.except_(a, b)) == [(2,)]
    assert rows(sets.intersect(a, b)) == [(1,)]
    assert sets.union_all(a, b).count() == 4
    assert sets.union_distinct(a, b).count() == 2


def test_partitioning(spark):
    df = spark.range(100)
    assert partitioning.by_key(df, ["id"], 7).rdd.getNumPartitions() == 7
    assert partitioning.rescale(df, 2).rdd.getNumPartitions() == 2
    assert partitioning.global_(df).rdd.getNumPartitions() == 1
    assert sorted(r.id for r in partitioning.salted(df, ["id"], 4, 5).collect()) == list(range(100))
    assert rows(partitioning.shuffle(df, 3)) == rows(df)


def test_running_reduction_of_a_user_function(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 1)], "k string, s int, v int")
    found = aggregation.reduce_running(df, ["k"], ["s"], lambda x, y: {**y, "v": x["v"] + y["v"]})
    assert rows(found) == [("a", 1, 5), ("a", 2, 12), ("b", 1, 1)]


@pytest.mark.parametrize(("how", "null_safe"), [("left", False), ("inner", True), ("right", False)])
def test_pairs_of_frequent_keys_are_spread(spark, how, null_safe):
    """Small tables of one split each: the pairs of their few keys come from many tasks."""
    left = spark.range(0, 600, 1, 1).select(F.col("id").alias("x"), F.expr("nullif(id % 3, 0)").alias("a"))
    right = spark.range(0, 90, 1, 1).select(F.col("id").alias("y"), F.expr("nullif(id % 3, 0)").alias("b"))
    if how == "right":
        left, right = left.where("x < 90"), right.crossJoin(spark.range(0, 5, 1, 1).select("id"))
    joined = joins.join(left, right, [("a", "b")], how, null_safe=null_safe)
    equal = left.a.eqNullSafe(right.b) if null_safe else left.a == right.b
    assert rows(joined) == rows(left.join(right, equal, how))
    assert joined.select(F.spark_partition_id()).distinct().count() >= 4


@pytest.mark.parametrize("columns", ["b, y", "b, y, z", "b", "s, d, b, y", "s, b"])
@pytest.mark.parametrize(("how", "null_safe"), [("left", False), ("left", True), ("inner", False), ("inner", True), ("right", False)])
def test_pairs_of_frequent_keys_come_from_one_array_a_key(spark, columns, how, null_safe):
    """Nulls among keys and values, keys of one side only, zeros of two signs: the pairs of the plain join."""
    left = spark.range(0, 60, 1, 1).selectExpr("id AS x", "nullif(id % 4, 0) AS a", "nullif(CAST(id % 2 AS string), '0') AS t", "IF(id % 3 = 0, -0.0D, 1) AS e")
    right = spark.range(0, 40, 1, 1).selectExpr("nullif(id % 5, 0) AS b", "nullif(id, 7) AS y", "id % 7 AS z", "nullif(CAST(id % 3 AS string), '0') AS s", "IF(id % 2 = 0, -0.0D, 0.0D) AS d")
    names = columns.split(", ")
    pairs = [p for p in (("a", "b"), ("t", "s"), ("e", "d")) if p[1] in names]
    right = right.select(names)
    if how == "right":
        left, right, pairs = right, left, [(b, a) for a, b in pairs]
    found = joins.join(left, right, pairs, how, null_safe=null_safe, many_pairs=True)
    plain = joins.join(left, right, pairs, how, null_safe=null_safe)
    assert found.columns == plain.columns and found.dtypes == plain.dtypes
    assert list(map(repr, rows(found))) == list(map(repr, rows(plain)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "collect_list" in plan.replace("CollectList", "collect_list")


@pytest.mark.parametrize("name", ["join_null_keys", "join_null_safe"])
def test_queries_of_all_pairs_broadcast_one_row_a_key(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and plan.count("BroadcastHashJoin") == 1


@pytest.mark.parametrize(("how", "null_safe"), [("left", False), ("inner", True)])
def test_pairs_of_frequent_keys_take_little_disk(spark, tmp_path, how, null_safe):
    """Blocks of rows meet blocks: a page of a written result repeats their values, and no task holds all pairs of a row."""
    left = spark.range(0, 2000, 1, 1).select(F.col("id").alias("x"), F.expr("nullif(id % 3, 0)").alias("a"))
    right = spark.range(0, 12000, 1, 1).select((F.col("id") * 7919 % 100003).alias("y"), F.expr("nullif(id % 3, 0)").alias("b"))
    joined = joins.join(left, right, [("a", "b")], how, null_safe=null_safe, many_pairs=True).select("x", "y")
    joined.write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs"))
    equal = left.a.eqNullSafe(right.b) if null_safe else left.a == right.b
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("x", "y") % 1000003), F.bit_xor(F.xxhash64("x", "y"))]
    assert found.agg(*digest).first() == left.join(right, equal, how).agg(*digest).first()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * found.count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate explode(__own") < plan.index("Coalesce") < plan.index("BroadcastHashJoin")


@pytest.mark.parametrize("keys", [["k"], []])
def test_hop_copies_are_made_after_the_last_shuffle(spark, keys):
    """Windows on both sides of a block's border are whole, and no row is copied into windows before a shuffle."""
    border = windows.BLOCK_WINDOWS * 60_000 // 2  # of blocks of 60 s windows, in milliseconds since the epoch
    made = [(i % 3, border + 977 * (i - 300), i) for i in range(600)]
    df = spark.createDataFrame(made, "k long, ms long, v long").select("k", F.timestamp_millis("ms").alias("t"), "v")
    found = windows.hop_agg(df, keys, "t", "60 seconds", "25 seconds", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))})
    plain = windows.window_agg(windows.hop(df, "t", "60 seconds", "25 seconds"), keys, {"n": F.count(F.lit(1)), "s": F.sum("v")})
    names = [*keys, "window_start", "window_end", "n", "s"]
    assert rows(found.select(names)) == rows(plain.select(names))
    before_last, shuffle, _ = found._jdf.queryExecution().executedPlan().toString().partition("Exchange ")
    assert shuffle and "Generate explode" in before_last and "Expand" not in before_last
