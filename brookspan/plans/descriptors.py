"""Plans from operator descriptors: dictionaries with column indexes, as a planner hands them to a runtime.

Inputs are DataFrames; columns are addressed by position and results are named
`f0`, `f1`, ....  Expressions are trees of REFERENCE, LITERAL, UNARY, BINARY,
FUNCTION, BETWEEN, IN, IS_NULL, IS_NOT_NULL, COALESCE and SWITCH nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookspan import functions as B
from brookspan.operators import aggregation, calc, joins, ranking, windows
from brookspan.types import spark_type

_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "ADD": lambda a, b: a + b, "SUBTRACT": lambda a, b: a - b, "MULTIPLY": lambda a, b: a * b, "DIVIDE": B.divide, "MODULUS": lambda a, b: a % b, "MOD": lambda a, b: a % b,
    "EQUAL": lambda a, b: a == b, "NOT_EQUAL": lambda a, b: a != b, "GREATER_THAN": lambda a, b: a > b, "GREATER_THAN_OR_EQUAL": lambda a, b: a >= b,
    "LESS_THAN": lambda a, b: a < b, "LESS_THAN_OR_EQUAL": lambda a, b: a <= b, "AND": lambda a, b: a & b, "OR": lambda a, b: a | b,
}
_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "LOWER": B.lower, "CHAR_LENGTH": B.char_length, "COALESCE": B.coalesce, "HOUR": B.hour, "PROCTIME": B.proctime, "PROCTIME_MATERIALIZE": lambda *_: B.proctime(), "MM3HASH": B.hash_code,
}
#: Functions with constant arguments after the first.
_CONSTANT = {
    "SPLIT_INDEX": B.split_index, "COUNT_CHAR": B.count_char, "DATE_FORMAT": B.date_format, "REGEX_EXTRACT": B.regex_extract, "JSON_VALUE": B.json_value,
    "JSON_QUERY": B.json_query, "TO_TIMESTAMP_LTZ": B.to_timestamp_ltz,
}


def named(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"f{i}" for i in range(len(df.columns))))


def _literal(node: dict) -> Column:
    value = F.lit(node.get("value"))
    return value.cast(spark_type(node["dataType"])) if "dataType" in node else value


def expression(node: dict) -> Column:
    """The column expression of a tree; a kind or function that is not known is an error."""
    kind = node["exprType"].upper()
    if kind == "REFERENCE":
        return F.col(f"f{node['index']}")
    if kind == "LITERAL":
        return _literal(node)
    if kind == "BINARY":
        return _BINARY[node["operator"].upper()](expression(node["left"]), expression(node["right"]))
    if kind == "UNARY":
        inner = expression(node["expr"])
        return {"NOT": lambda: ~inner, "NEGATE": lambda: -inner}[node["operator"].upper()]()
    if kind in ("IS_NULL", "IS_NOT_NULL"):
        inner = expression(node["expr"])
        return inner.isNull() if kind == "IS_NULL" else inner.isNotNull()
    if kind == "BETWEEN":
        return expression(node["value"]).between(expression(node["lower"]), expression(node["upper"]))
    if kind == "IN":
        first, *rest = map(expression, node["arguments"])
        return first.isin(*rest)
    if kind == "COALESCE":
        return F.coalesce(*map(expression, node["arguments"]))
    if kind == "SWITCH":
        cases = node["cases"]
        out = reduce(lambda so_far, c: so_far.when(expression(c["when"]), expression(c["then"])), cases[1:], F.when(expression(cases[0]["when"]), expression(cases[0]["then"])))
        return out.otherwise(expression(node["else"])) if "else" in node else out
    if kind == "CAST":
        return expression(node["expr"]).cast(spark_type(node["dataType"]))
    if kind == "FUNCTION":
        name, arguments = node["name"].upper(), node.get("arguments", [])
        if name in _CONSTANT:
            return _CONSTANT[name](expression(arguments[0]), *(a["value"] for a in arguments[1:]))
        if name in _FUNCTIONS:
            return _FUNCTIONS[name](*map(expression, arguments))
    raise ValueError(f"unsupported expression {node}")


def _aggregates(calls: list[dict], weight: Column | None = None) -> dict[str, Column]:
    out = {}
    for i, call in enumerate(calls):
        name = call["name"].upper()
        if name == "COUNT" and call.get("distinct"):
            name = "COUNT_DISTINCT"
        where = F.col(f"f{call['filterArg']}") if call.get("filterArg", -1) >= 0 else None
        out[f"a{i}"] = B.agg(name, *(F.col(f"f{k}") for k in call.get("argIndexes", [])), where=where, weight=weight)
    return out


def _window(df: DataFrame, d: dict) -> DataFrame:
    time, kind = f"f{d['timeAttributeIndex']}", d["windowType"].upper()
    span = lambda key: f"{d.get(key, 0)} milliseconds"
    zone = d.get("shiftTimeZone")
    if kind == "TUMBLE":
        return windows.tumble(df, time, span("windowSize"), span("windowOffset"), zone)
    if kind == "HOP":
        return windows.hop(df, time, span("windowSize"), span("windowSlide"), span("windowOffset"), zone)
    if kind == "CUMULATE":
        return windows.cumulate(df, time, span("maxSize"), span("step"), span("windowOffset"), zone)
    raise ValueError(f"unknown window {kind}")


def _order(d: dict) -> list[tuple[str, bool]]:
    return list(zip((f"f{i}" for i in d["sortFieldIndices"]), d["sortAscendingOrders"], strict=True))


def _calc(d: dict, df: DataFrame) -> DataFrame:
    where = expression(d["condition"]) if d.get("condition") else None
    return calc.calc(df, {f"f{i}": expression(e) if isinstance(e, dict) else F.col(f"f{e}") for i, e in enumerate(d["indices"])}, where)


def _expand(d: dict, df: DataFrame) -> DataFrame:
    return calc.expand(df, [{f"f{i}": expression(e) for i, e in enumerate(p["indices"])} for p in d["projects"]])


def _join(d: dict, left: DataFrame, right: DataFrame) -> DataFrame:
    shifted = right.toDF(*(f"f{len(left.columns) + i}" for i in range(len(right.columns))))
    pairs = [(f"f{a}", f"f{len(left.columns) + b}") for a, b in zip(d["leftJoinKey"], d["rightJoinKey"], strict=True)]
    if "leftWindowEndIndex" in d:
        pairs.append((f"f{d['leftWindowEndIndex']}", f"f{len(left.columns) + d['rightWindowEndIndex']}"))
    condition = expression(d["nonEquiCondition"]) if d.get("nonEquiCondition") else None
    how = {"INNERJOIN": "inner", "LEFTOUTERJOIN": "left", "RIGHTOUTERJOIN": "right", "FULLOUTERJOIN": "full", "SEMI": "left_semi", "ANTI": "left_anti"}[d["joinType"].upper()]
    return named(joins.join(left, shifted, pairs, how, condition, null_safe=not all(d.get("filterNulls", [True]))))


def _lookup(d: dict, df: DataFrame, table: DataFrame) -> DataFrame:
    shifted = table.toDF(*(f"t{i}" for i in range(len(table.columns))))
    selected = [f"t{i}" for i in d["selectedFields"]]
    found = joins.lookup_join(df, shifted, (f"f{d['lookupKeys'][0]}", f"t{d['lookupKeys'][1]}"), {"INNERJOIN": "inner", "LEFTOUTERJOIN": "left"}[d["joinType"].upper()], selected)
    return named(found.select(*df.columns, *selected))


def _group(d: dict, df: DataFrame) -> DataFrame:
    return named(aggregation.group_agg(df, [f"f{i}" for i in d["grouping"]], _aggregates(d["aggregateCalls"]), d.get("rowKind")))


def _window_agg(d: dict, df: DataFrame) -> DataFrame:
    keys = [f"f{i}" for i in d["grouping"]]
    if d["windowType"].upper() == "SESSION":
        return named(windows.session_agg(df, keys, f"f{d['timeAttributeIndex']}", f"{d['windowSize']} milliseconds", _aggregates(d["aggregateCalls"])))
    return named(windows.window_agg(_window(df, d), keys, _aggregates(d["aggregateCalls"])))


def _rank(d: dict, df: DataFrame) -> DataFrame:
    if not d.get("partitionKey"):
        raise ValueError("a rank has a partition key")
    rank = "rank" if d.get("outputRankNumber") else None
    seq = f"f{d['sequenceIndex']}" if "sequenceIndex" in d else None
    keys = [f"f{i}" for i in d["partitionKey"]]
    return named(ranking.top_n(df, keys, _order(d), d["rankEnd"], d.get("rankStart", 1), seq, rank, d.get("sortNullsIsLast", True)))


def _deduplicate(d: dict, df: DataFrame) -> DataFrame:
    seq = f"f{d['sequenceIndex']}" if "sequenceIndex" in d else None
    return ranking.deduplicate(df, [f"f{i}" for i in d["grouping"]], f"f{d['rowtimeIndex']}", "last" if d["keepLastRow"] else "first", seq)


OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "CALC": _calc, "EXPAND": _expand, "JOIN": _join, "WINDOW_JOIN": _join, "LOOKUP_JOIN": _lookup, "GROUP_AGGREGATE": _group, "WINDOW_AGGREGATE": _window_agg,
    "GROUP_WINDOW_AGGREGATE": _window_agg, "RANK": _rank, "DEDUPLICATE": _deduplicate,
    "WATERMARK": lambda d, df: windows.watermark(df, f"f{d['rowtimeFieldIndex']}", f"{d['intervalSecond']} seconds"),
}


def plan(descriptor: dict, inputs: dict[str, DataFrame]) -> DataFrame:
    """A tree of descriptors with `operator` and `inputs` (descriptors, or names of tables)."""
    if descriptor["operator"] not in OPERATORS:
        raise ValueError(f"unknown operator {descriptor['operator']!r}")
    below = [named(inputs[i]) if isinstance(i, str) else plan(i, inputs) for i in descriptor["inputs"]]
    return OPERATORS[descriptor["operator"]](descriptor, *below)
