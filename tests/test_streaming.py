"""Changelog operators over micro-batches give, replayed, the batch operators' results."""

import pytest
from brookspan import functions as B
from brookspan.operators import aggregation, changelog, joins, ranking, windows
from brookspan.streaming import processors
from brookspan.streaming.running import collected, stream_of
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bag(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sixty changes in three files: every fourth takes back the one before it."""
    path = tmp_path_factory.mktemp("stream")
    rows, last = [], None
    for i in range(60):
        if i % 4 == 3:
            rows.append((i, *last, "-D"))
        else:
            last = (i % 5, None if i % 7 == 0 else (i * 37) % 23, f"t{i % 3}")
            rows.append((i, *last, "+I"))
    schema = "seq long, k long, v long, s string, row_kind string"
    for part in range(3):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
    return str(path / "in"), schema


AGGREGATES = {"n": ("COUNT", None), "c": ("COUNT", "v"), "s": ("SUM", "v"), "a": ("AVG", "v"), "lo": ("MIN", "v"), "hi": ("MAX", "s"), "d": ("COUNT_DISTINCT", "v")}
def batch_aggregates():
    return {"n": B.count(), "c": B.count("v"), "s": B.sum_("v"), "a": B.avg("v"), "lo": B.min_("v"), "hi": B.max_("s"), "d": B.count_distinct("v")}


def test_group_agg_with_retraction(spark, folder, tmp_path):
    path, schema = folder
    emitted = collected(processors.group_agg(stream_of(spark, path, schema), ["k"], AGGREGATES, "row_kind", "seq"), str(tmp_path / "c"))
    batch = aggregation.group_agg(spark.read.parquet(path).drop("seq"), ["k"], batch_aggregates(), row_kind="row_kind")
    assert bag(changelog.netted(emitted)) == bag(batch)
    assert {r.row_kind for r in emitted.collect()} >= {"+I", "-U", "+U"}


@pytest.mark.parametrize("rank", ["rank", None])
def test_top_n(spark, folder, tmp_path, rank):
    path, schema = folder
    rows = lambda df: df.where("row_kind = '+I'").drop("row_kind")
    emitted = collected(processors.top_n(rows(stream_of(spark, path, schema)), ["k"], [("v", False)], 4, 2, "seq", rank), str(tmp_path / "c"))
    batch = ranking.top_n(rows(spark.read.parquet(path)), ["k"], [("v", False)], 4, 2, "seq", rank)
    assert bag(changelog.netted(emitted)) == bag(batch)


@pytest.mark.parametrize("keep", ["first", "last"])
def test_deduplicate(spark, folder, tmp_path, keep):
    path, schema = folder
    rows = lambda df: df.where("row_kind = '+I'").drop("row_kind").withColumn("t", F.timestamp_seconds(F.floor(F.col("seq") / 4)))
    emitted = collected(processors.deduplicate(rows(stream_of(spark, path, schema)), ["s"], "t", keep, "seq"), str(tmp_path / "c"))
    batch = ranking.deduplicate(rows(spark.read.parquet(path)), ["s"], "t", keep, "seq")
    assert bag(changelog.netted(emitted)) == bag(batch)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_retraction(spark, folder, tmp_path, how):
    path, schema = folder
    left = lambda df: df.where("seq % 8 < 4").select("seq", "row_kind", F.expr("nullif(k, 2)").alias("k"), "v")
    right = lambda df: df.where("seq % 8 >= 4 and s <> 't1'").select("seq", "row_kind", F.expr("nullif(k, 2)").alias("rk"), F.col("s").alias("rs"))
    stream = stream_of(spark, path, schema)
    emitted = collected(processors.join(left(stream), right(stream_of(spark, path, schema)), [("k", "rk")], how), str(tmp_path / "c"), "append")
    table = spark.read.parquet(path)
    sides = [changelog.netted(side(table).drop("seq")) for side in (left, right)]
    assert bag(changelog.netted(emitted)) == bag(joins.join(*sides, [("k", "rk")], how))


def test_reduce(spark, folder, tmp_path):
    path, schema = folder
    function = lambda a, b: {**b, "v": (a["v"] or 0) + (b["v"] or 0)}
    rows = lambda df: df.select("k", "seq", "v")
    emitted = collected(processors.reduce_by_key(rows(stream_of(spark, path, schema)), ["k"], function, "seq"), str(tmp_path / "c"), "append")
    last = {r.k: r.v for r in emitted.orderBy("seq").collect()}
    whole = {r.k: r.s for r in rows(spark.read.parquet(path)).groupBy("k").agg(F.sum(F.coalesce("v", F.lit(0))).alias("s")).collect()}
    assert last == whole


def test_co_process_shares_state(spark, folder, tmp_path):
    path, schema = folder

    def function(side, row, state, timers):
        state[side] = state.get(side, 0) + 1
        return [{"k": row["k"], "l": state.get("l", 0), "r": state.get("r", 0)}]

    out = T.StructType.fromDDL("k long, l long, r long")
    sides = [stream_of(spark, path, schema).select("k").where(f"k % 2 = {i} or k = 0") for i in (0, 1)]
    emitted = collected(processors.co_process(*sides, "k", function, out), str(tmp_path / "c"), "append")
    most = {r.k: (r.l, r.r) for r in emitted.groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r")).collect()}
    assert most == {0: (12, 12), 1: (0, 12), 2: (12, 0), 3: (0, 12), 4: (12, 0)}


def test_process_holds_value_list_and_map_state(spark, folder, tmp_path):
    path, schema = folder

    def function(key, row, state, timers):
        state["n"].set(state["n"].get(0) + 1)
        state["seen"].add(row["seq"])
        state["by_s"].put(row["s"], state["by_s"].get(row["s"], 0) + 1)
        if row["s"] == "t2":
            state["by_s"].remove("t2")
        return [{"k": key[0], "n": state["n"].get(), "seen": sum(state["seen"].all()), "squares": sum(n * n for _, n in state["by_s"].items())}]

    out = T.StructType.fromDDL("k long, n long, seen long, squares long")
    stream = processors.process(stream_of(spark, path, schema), ["k"], function, out, {"n": "value", "seen": "list", "by_s": "map"}, seq="seq")
    last = {r.k: (r.n, r.seen, r.squares) for r in collected(stream, str(tmp_path / "c"), "append").orderBy("n").collect()}
    kinds = spark.read.parquet(path).groupBy("k", "s").agg(F.count("*").alias("n"), F.sum("seq").alias("seen"))
    kinds = kinds.groupBy("k").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum(F.expr("if(s = 't2', 0, n * n)")).alias("squares"))
    assert last == {r.k: (r.n, r.seen, r.squares) for r in kinds.collect()}


def test_event_timers_fire_when_the_watermark_passes(spark, tmp_path):
    for rows in ([(1, 1), (2, 5)], [(1, 3)], [(9, 10**6)]):
        made = spark.createDataFrame(rows, "k long, s long").withColumn("t", F.timestamp_seconds("s"))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def function(key, row, state, timers):
        if (due := state["due"].get()) is not None:
            timers.delete(due)
        timers.register(row["s"] * 1000 + 10_000)
        state["due"].set(row["s"] * 1000 + 10_000)
        state["n"].set(state["n"].get(0) + 1)

    def on_timer(key, at, state, timers):
        n = state["n"].get()
        state["n"].clear()
        return [{"k": key[0], "at": at, "n": n}]

    stream = windows.watermark(stream_of(spark, str(tmp_path / "in"), "k long, s long, t timestamp"), "t", "5 seconds")
    out = T.StructType.fromDDL("k long, at long, n long")
    stream = processors.process(stream, ["k"], function, out, {"due": "value", "n": "value"}, on_timer, "EventTime", seq="s")
    assert {tuple(r) for r in collected(stream, str(tmp_path / "c"), "append").collect()} == {(1, 13_000, 2), (2, 15_000, 1)}
    with pytest.raises(ValueError):
        processors.process(stream, ["k"], function, out, {"n": "value"}, ttl_ms=1000)


def test_windows_with_watermark_equal_the_batch(spark, tmp_path):
    rows = spark.range(40).select(F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("t"), (F.col("id") % 2).alias("k"))
    end = spark.range(1).select(F.timestamp_seconds(F.lit(10**6)).cast("timestamp_ntz").alias("t"), F.lit(9).cast("long").alias("k"))
    for i in range(4):
        rows.where(f"second(t) >= 0 and floor(unix_seconds(cast(t as timestamp)) / 70) = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end.write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.watermark(stream_of(spark, str(tmp_path / "in"), "t timestamp_ntz, k long"), "t", "10 seconds")
    emitted = collected(windows.window_agg(windows.tumble(stream, "t", "30 seconds"), ["k"], {"n": B.count()}), str(tmp_path / "c"), "append")
    batch = windows.window_agg(windows.tumble(windows.watermark(rows, "t", "1 second"), "t", "30 seconds"), ["k"], {"n": B.count()})
    assert bag(emitted.where("k < 9")) == bag(batch)


def test_late_rows_are_dropped(spark, tmp_path):
    for t in (5, 100, 200, 7, 10**6):  # 7 comes when its window is closed
        spark.createDataFrame([(t,)], "s long").select(F.timestamp_seconds("s").alias("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.watermark(stream_of(spark, str(tmp_path / "in"), "t timestamp"), "t", "0 seconds")
    emitted = collected(windows.window_agg(windows.tumble(stream, "t", "10 seconds"), [], {"n": B.count()}), str(tmp_path / "c"), "append")
    assert sorted(r.n for r in emitted.collect()) == [1, 1, 1]
