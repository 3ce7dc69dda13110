"""Joins, expansion and intersection over every row of their tables."""

import pytest
from brookspan.plans import queries


@pytest.fixture(scope="module")
def count(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()


def ran(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir)


def test_outer_joins_have_every_row_and_unmatched_ones(spark, sf_dir, count):
    full = ran(spark, sf_dir, "join_whole_full")
    assert full.select("o_orderkey").dropna().distinct().count() == count("orders")
    assert full.select("c_custkey").dropna().distinct().count() == count("customer")
    assert full.where("c_custkey is null").count() > 0 and full.where("o_orderkey is null").count() > 0
    assert ran(spark, sf_dir, "join_whole_left").count() == count("orders")
    assert ran(spark, sf_dir, "join_whole_right").select("c_custkey").distinct().count() == count("customer")


def test_semi_and_anti_join_share_out_all_orders(spark, sf_dir, count):
    semi, anti = (ran(spark, sf_dir, f"join_whole_{k}").count() for k in ("semi", "anti"))
    assert semi and anti and semi + anti == count("orders")
    assert ran(spark, sf_dir, "join_whole_inner").count() == semi


def test_every_line_is_expanded(spark, sf_dir, count):
    assert ran(spark, sf_dir, "expand_projections_whole").count() == 2 * count("lineitem")
