"""Plans from descriptors."""

import datetime as dt

import pytest
from brookspan.plans.descriptors import plan


def ref(i):
    return {"exprType": "REFERENCE", "index": i}


def lit(v):
    return {"exprType": "LITERAL", "value": v}


def binary(op, a, b):
    return {"exprType": "BINARY", "operator": op, "left": a, "right": b}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def tables(spark):
    t = lambda s: dt.datetime(2020, 1, 1, 0, 0, s)
    return {
        "bid": spark.createDataFrame([(1, 10, t(1)), (1, 30, t(2)), (2, 5, t(11)), (None, 7, t(12))], "auction long, price long, at timestamp_ntz"),
        "auction": spark.createDataFrame([(1, "a"), (3, "c")], "id long, name string"),
    }


def test_calc(tables):
    case = {"exprType": "SWITCH", "cases": [{"when": binary("GREATER_THAN_OR_EQUAL", ref(1), lit(20)), "then": lit("high")}], "else": lit("low")}
    d = {"operator": "CALC", "inputs": ["bid"], "indices": [0, binary("MODULUS", ref(1), lit(4)), case], "condition": {"exprType": "BETWEEN", "value": ref(1), "lower": lit(6), "upper": lit(40)}}
    assert rows(plan(d, tables)) == [(1, 2, "high"), (1, 2, "low"), (None, 3, "low")]


def test_joins(tables):
    d = {"operator": "JOIN", "inputs": ["bid", "auction"], "joinType": "LeftOuterJoin", "leftJoinKey": [0], "rightJoinKey": [0], "nonEquiCondition": binary("GREATER_THAN", ref(1), lit(20))}
    assert [(r.f1, r.f4) for r in plan(d, tables).orderBy("f1").collect()] == [(5, None), (7, None), (10, None), (30, "a")]
    d = {"operator": "LOOKUP_JOIN", "inputs": ["bid", "auction"], "joinType": "InnerJoin", "lookupKeys": [0, 0], "selectedFields": [1]}
    assert [(r.f1, r.f3) for r in plan(d, tables).orderBy("f1").collect()] == [(10, "a"), (30, "a")]


def test_aggregates_and_windows(tables):
    calls = [{"name": "COUNT"}, {"name": "MAX", "argIndexes": [1]}]
    assert rows(plan({"operator": "GROUP_AGGREGATE", "inputs": ["bid"], "grouping": [0], "aggregateCalls": calls}, tables)) == [(1, 2, 30), (2, 1, 5), (None, 1, 7)]
    window = {"operator": "WINDOW_AGGREGATE", "inputs": ["bid"], "grouping": [], "aggregateCalls": calls, "timeAttributeIndex": 2, "windowSize": 10000}
    for extra, n in (({"windowType": "TUMBLE"}, 2), ({"windowType": "HOP", "windowSlide": 5000}, 4), ({"windowType": "CUMULATE", "maxSize": 20000, "step": 10000}, 2), ({"windowType": "SESSION", "windowSize": 5000}, 2)):
        assert plan(window | extra, tables).count() == n


def test_rank_and_deduplicate(tables):
    rank = {"operator": "RANK", "inputs": ["bid"], "partitionKey": [0], "sortFieldIndices": [1], "sortAscendingOrders": [False], "rankEnd": 1, "outputRankNumber": True}
    assert [(r.f0, r.f1, r.f3) for r in plan(rank, tables).where("f0 is not null").orderBy("f0").collect()] == [(1, 30, 1), (2, 5, 1)]
    keep = {"operator": "DEDUPLICATE", "inputs": ["bid"], "grouping": [0], "rowtimeIndex": 2, "keepLastRow": False}
    assert [(r.f0, r.f1) for r in plan(keep, tables).where("f0 = 1").collect()] == [(1, 10)]
    with pytest.raises(ValueError):
        plan(rank | {"partitionKey": []}, tables)


def test_expand_of_a_nested_plan(tables):
    inner = {"operator": "CALC", "inputs": ["auction"], "indices": [ref(0)], "condition": {"exprType": "IN", "arguments": [ref(0), lit(1)]}}
    assert rows(plan({"operator": "EXPAND", "inputs": [inner], "projects": [{"indices": [ref(0), lit(0)]}, {"indices": [lit(9), lit(1)]}]}, tables)) == [(1, 0), (9, 1)]


def test_what_is_not_known_is_an_error(tables):
    with pytest.raises(ValueError):
        plan({"operator": "NONSENSE", "inputs": ["bid"]}, tables)
    with pytest.raises(ValueError):
        plan({"operator": "CALC", "inputs": ["bid"], "indices": [{"exprType": "FUNCTION", "name": "NONSENSE"}]}, tables)
