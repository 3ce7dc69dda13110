"""Sources and sinks."""

import pytest
from brookspan import sources
from brookspan.plans import nexmark
from brookspan.sources.nexmark import FIRST_PERSON, join_pairs
from brookspan.types import schema
from pyspark.sql import functions as F


def test_csv_values_that_cannot_be_read_are_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,x,2020-01-01 00:00:00\nnull,"a,b",oops\nzz,null,\n')
    fields = schema({"n": "BIGINT", "s": "VARCHAR", "t": "TIMESTAMP(3)"})
    got = sources.read_csv(spark, str(tmp_path), fields, ["n", "s"]).collect()
    assert [tuple(r) for r in got] == [(1, "x"), (None, "a,b"), (None, None)]
    assert sources.read_csv(spark, str(tmp_path), fields).where("t is not null").count() == 1


def test_file_sink_and_commit(spark, tmp_path):
    out, staged = str(tmp_path / "out"), str(tmp_path / "in")
    spark.range(20).select(F.col("id").alias("v"), F.concat(F.lit("h"), F.col("id") % 2).alias("hour")).write.parquet(staged)
    stream = spark.readStream.schema("v long, hour string").parquet(staged)
    sources.file_sink(stream, out, ["hour"], str(tmp_path / "c"), rows_per_file=5).awaitTermination()
    back = spark.read.schema("v long, hour string").csv(out)
    assert back.count() == 20 and back.where("hour = 'h1'").count() == 10
    time_of = lambda keys: 1000 * int(keys["hour"][1:])
    assert [p.rsplit("/", 1)[1] for p in sources.commit_partitions(spark, out, time_of, 1500, "1 second")] == ["hour=h0"]
    assert [p.rsplit("/", 1)[1] for p in sources.commit_partitions(spark, out, time_of, 2000, "1 second")] == ["hour=h1"]
    seen = []
    sources.commit_partitions(spark, out, time_of, 9999, policy="callback", on_commit=seen.append)
    assert len(seen) == 2
    with pytest.raises(ValueError):
        sources.commit_partitions(spark, out, time_of, 0, policy="other")


def test_json_rows(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null, "c": "x"}',), ('{"c": "y"}',)], "value string")
    assert [tuple(r) for r in sources.json_rows(df, schema({"a": "BIGINT", "b": "INT", "c": "STRING"})).collect()] == [(1, None, "x"), (None, None, "y")]
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.json_rows(spark.createDataFrame([("{",)], "value string"), schema({"a": "BIGINT"})).collect()


def test_json_values(spark):
    df = spark.sql("SELECT 1 AS a, TIMESTAMP_NTZ'2020-01-02 03:04:05.120' AS t, TIMESTAMP_NTZ'2020-01-02 03:04:10' AS u, CAST(NULL AS STRING) AS n")
    assert sources.to_json_value(df).first().value == '{"a":1,"t":"2020-01-02 03:04:05.12","u":"2020-01-02 03:04:10","n":null}'


def test_kafka_needs_its_connector_and_offers_no_exactly_once(spark):
    with pytest.raises(Exception, match="kafka"):
        sources.kafka_source(spark, "localhost:9", "t").schema  # noqa: B018
    with pytest.raises(ValueError):
        sources.kafka_sink(spark.range(1), "localhost:9", "t", guarantee="exactly-once")


def test_generator_mix_and_references(spark):
    wide = sources.nexmark_events(spark, 5000)
    assert dict(wide.groupBy("event_type").count().collect()) == {0: 100, 1: 300, 2: 4600}
    assert wide.where("person is not null").count() == 100
    again = sources.nexmark_events(spark, 5000, partitions=3)
    assert again.agg(F.bit_xor(F.xxhash64("*"))).first() == wide.agg(F.bit_xor(F.xxhash64("*"))).first()
    made = sources.nexmark_tables(wide)
    assert made["bid"].join(made["auction"], F.col("auction") == F.col("id"), "left_anti").count() == 0
    assert made["bid"].agg(F.min("bidder")).first()[0] >= FIRST_PERSON
    assert made["auction"].where("expires <= dateTime").count() == 0


@pytest.mark.parametrize("name", sorted(nexmark.ALL))
def test_benchmark_queries_run_on_generated_events(spark, name):
    made = sources.nexmark_tables(sources.nexmark_events(spark, 3000))
    side = spark.range(10000).select(F.col("id").alias("key"), F.col("id").cast("string").alias("value"))
    assert nexmark.ALL[name](made | {"side_input": side}).count() > 0 or name in ("q2", "q3")


def test_join_pairs(spark):
    made = join_pairs(spark, 10, 2, 3, 1000)
    assert {(r.key, r.side): r["count"] for r in made.groupBy("key", "side").count().collect()} == {(k, s): n for k in range(10) for s, n in (("left", 2), ("right", 3))}
