"""Keyed state machines of the changelog operators, for `transformWithStateInPandas`.

Every operator takes rows and emits rows with a `row_kind`.  State is keyed, so
it is spread over tasks like the keys; rows of a micro-batch are handled in the
order of a sequence column.  A changelog replayed by `changelog.materialize` or
`changelog.netted` equals the batch operator's result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brookspan.operators.changelog import DELETE, INSERT, UPDATE_AFTER, UPDATE_BEFORE

ADDS = (INSERT, UPDATE_AFTER)


def _plain(value: Any) -> Any:
    """A value as JSON can hold it; pandas' missing values are null."""
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


class Keyed(StatefulProcessor):
    """Holds one JSON document per key; subclasses turn (state, rows) into (state, changes)."""

    def __init__(self, columns: list[str], seq: str | None, fields: list[tuple[str, str]]):
        """columns: of the input that reach the rows; fields: names and kinds of the output, kind `time` for timestamps."""
        self.columns, self.seq, self.fields = columns, seq, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        if self.seq:
            frame = frame.sort_values(self.seq, kind="stable")
        held = json.loads(self.state.get()[0]) if self.state.exists() else None
        incoming = [{c: _plain(v) for c, v in zip(self.columns, values, strict=True)} for values in frame[self.columns].itertuples(index=False)]
        held, out = self.fold(held, incoming)
        if held is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(held),))
        yield self.frame(key, out)

    def frame(self, key: tuple, out: list[dict]) -> pd.DataFrame:
        names = [n for n, _ in self.fields]
        rows = [[row.get(n) for n in names] for row in out]
        made = pd.DataFrame(rows, columns=names)
        for name, kind in self.fields:
            if kind == "time":
                made[name] = pd.to_datetime(made[name], format="ISO8601")
            elif kind == "long":
                made[name] = made[name].astype("Int64")
        return made

    def fold(self, held, rows: list[dict]):
        raise NotImplementedError

    def close(self) -> None:
        pass


def _kinds(schema: T.StructType) -> list[tuple[str, str]]:
    def kind(t: T.DataType) -> str:
        return "time" if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else "long" if isinstance(t, T.IntegralType) else "plain"

    return [(f.name, kind(f.dataType)) for f in schema]


def _run(df: DataFrame, keys: list[str], processor: Keyed, schema: T.StructType, mode: str = "update", time_mode: str = "none") -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode=mode, timeMode=time_mode)


def _with_kind(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField("row_kind", T.StringType()), *(T.StructField(f.name, f.dataType) for f in fields)])


class GroupAgg(Keyed):
    """COUNT, SUM, AVG, MIN, MAX and COUNT_DISTINCT of a key, with retraction.

    The first result is +I, an equal one is suppressed, a changed one gives -U
    (if asked for) and +U; a key without rows left gives -D and its state goes.
    A row taken back of a key that is not known is ignored.
    """

    def __init__(self, keys, aggregates: dict[str, tuple[str, str | None]], kind: str | None, before: bool, *rest):
        super().__init__(*rest)
        self.keys, self.aggregates, self.kind, self.before = keys, aggregates, kind, before

    def fold(self, held, rows):
        start = held
        for row in rows:
            adds = self.kind is None or row[self.kind] in ADDS
            if held is None:
                if not adds:
                    continue
                held = {"n": 0, "parts": {name: {"n": 0, "s": 0, "bag": {}} for name in self.aggregates}, "last": None, "key": {k: row[k] for k in self.keys}}
            w = 1 if adds else -1
            held["n"] += w
            for name, (function, column) in self.aggregates.items():
                value, part = (1 if column is None else row[column]), held["parts"][name]
                if value is None:
                    continue
                part["n"] += w
                if function in ("SUM", "AVG"):
                    part["s"] += w * value
                elif function in ("MIN", "MAX", "COUNT_DISTINCT"):
                    mark = json.dumps(value)
                    left = part["bag"].get(mark, 0) + w
                    if left > 0:
                        part["bag"][mark] = left
                    else:
                        part["bag"].pop(mark, None)
        if held is None:
            return None, []
        old, key = held["last"], held["key"]
        if held["n"] <= 0:
            return None, [{"row_kind": DELETE, **key, **old}] if old is not None else []
        new = {name: self.result(function, held["parts"][name]) for name, (function, _) in self.aggregates.items()}
        held["last"] = new
        if old is None:
            return held, [{"row_kind": INSERT, **key, **new}]
        if old == new and start is not None:
            return held, []
        return held, [*([{"row_kind": UPDATE_BEFORE, **key, **old}] if self.before else []), {"row_kind": UPDATE_AFTER, **key, **new}]

    @staticmethod
    def result(function: str, part: dict):
        if function == "COUNT":
            return part["n"]
        if function == "COUNT_DISTINCT":
            return len(part["bag"])
        if part["n"] <= 0:
            return None
        if function == "SUM":
            return part["s"]
        if function == "AVG":
            return abs(part["s"]) // part["n"] * (1 if part["s"] >= 0 else -1)
        return (min if function == "MIN" else max)(map(json.loads, part["bag"]))


def group_agg(
    df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str | None]], row_kind: str | None = None, seq: str | None = None, update_before: bool = True
) -> DataFrame:
    """aggregates: name -> (function, column or None for COUNT of rows).  Columns are integers, strings or timestamps."""
    fields = {f.name: f for f in df.schema}
    out = [fields[k] for k in keys] + [
        T.StructField(n, T.LongType() if f in ("COUNT", "SUM", "AVG", "COUNT_DISTINCT") else fields[c].dataType) for n, (f, c) in aggregates.items()
    ]
    schema = _with_kind(out)
    columns = list(dict.fromkeys([*keys, *(c for _, c in aggregates.values() if c), *([row_kind] if row_kind else [])]))
    return _run(df, keys, GroupAgg(keys, aggregates, row_kind, update_before, columns, seq, _kinds(schema)), schema)


class TopN(Keyed):
    """Rows `start` to `end` of a key by order, an equal newcomer behind those before it.

    With a rank column every shifted place gives -U and +U, a new place +I;
    without one, what falls out gives -D and what comes in +I.
    """

    def __init__(self, order, start, end, rank, *rest):
        super().__init__(*rest)
        self.order, self.start, self.end, self.rank = order, start, end, rank

    def place(self, row: dict) -> tuple:
        out = []
        for column, up in self.order:
            value = row[column]
            out.append((value is None, value if value is None or up else _Reversed(value)))
        return tuple((missing, 0 if missing else value) for missing, value in out)

    def fold(self, held, rows):
        best = held or []
        before = best[self.start - 1 :]
        for row in rows:
            at = len(best)
            while at and self.place(row) < self.place(best[at - 1]):
                at -= 1
            best.insert(at, row)
            del best[self.end :]
        after = best[self.start - 1 :]
        out = []
        if self.rank:
            for i, new in enumerate(after):
                rank = {self.rank: self.start + i}
                if i >= len(before):
                    out.append({"row_kind": INSERT, **new, **rank})
                elif before[i] != new:
                    out += [{"row_kind": UPDATE_BEFORE, **before[i], **rank}, {"row_kind": UPDATE_AFTER, **new, **rank}]
        else:
            gone, come = list(before), []
            for new in after:
                if new in gone:
                    gone.remove(new)
                else:
                    come.append(new)
            out = [{"row_kind": DELETE, **r} for r in gone] + [{"row_kind": INSERT, **r} for r in come]
        return best, out


class _Reversed:
    """Turns an order around."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


def top_n(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], end: int, start: int = 1, seq: str | None = None, rank: str | None = "rank") -> DataFrame:
    schema = _with_kind([*df.schema, *([T.StructField(rank, T.LongType())] if rank else [])])
    return _run(df, keys, TopN(order, start, end, rank, df.columns, seq, _kinds(schema)), schema)


class Deduplicate(Keyed):
    """First or last row of a key by row time; a tie goes to the later row (last) or the earlier one (first)."""

    def __init__(self, time, keep, before, *rest):
        super().__init__(*rest)
        self.time, self.keep, self.before = time, keep, before

    def fold(self, held, rows):
        best = held
        for row in rows:
            if best is None or (best[self.time] <= row[self.time] if self.keep == "last" else row[self.time] < best[self.time]):
                best = row
        if held is None:
            return best, [{"row_kind": INSERT, **best}] if best else []
        if best == held:
            return best, []
        return best, [*([{"row_kind": UPDATE_BEFORE, **held}] if self.before else []), {"row_kind": UPDATE_AFTER, **best}]


def deduplicate(df: DataFrame, keys: list[str], time: str, keep: str = "first", seq: str | None = None, update_before: bool = True) -> DataFrame:
    schema = _with_kind(list(df.schema))
    return _run(df, keys, Deduplicate(time, keep, update_before, df.columns, seq, _kinds(schema)), schema)


class Join(Keyed):
    """Inner or left join of two tagged changelogs, without a bound on time; rows are bags on both sides.

    A left row without a match is +I with nulls; its first match takes that back
    (-D) before the joined +I, and when the last match goes it comes back.
    """

    def __init__(self, left_columns, right_columns, outer, condition, *rest):
        super().__init__(*rest)
        self.left, self.right, self.outer, self.condition = left_columns, right_columns, outer, condition

    def fold(self, held, rows):
        held = held or {"l": [], "r": []}  # lists of [row, count]
        out: list[dict] = []
        empty = dict.fromkeys(self.right)

        def emit(kind, a, b):
            out.append({"row_kind": kind, **a, **b})

        def matches(a, b) -> bool:
            return a["join_key"] is not None and (self.condition is None or bool(self.condition({**a, **b})))

        def change(bag, row, w) -> bool:
            for entry in bag:
                if entry[0] == row:
                    entry[1] += w
                    if entry[1] <= 0:
                        bag.remove(entry)
                    return True
            if w > 0:
                bag.append([row, w])
                return True
            return False  # taken back but never seen

        for row in rows:
            kind, w = row["row_kind"], 1 if row["row_kind"] in ADDS else -1
            mine = {"join_key": row["join_key"], **{c: row[c] for c in (self.left if row["join_side"] == "l" else self.right)}}
            if not change(held[row["join_side"]], mine, w):
                continue
            if row["join_side"] == "l":
                found = [(b, n) for b, n in held["r"] if matches(mine, b)]
                for b, n in found:
                    for _ in range(n):
                        emit(kind, mine, b)
                if not found and self.outer:
                    emit(kind, mine, empty)
            else:
                for a, n in held["l"]:
                    if not matches(a, mine):
                        continue
                    others = sum(k for b, k in held["r"] if matches(a, b))
                    for _ in range(n):
                        if self.outer and w > 0 and others == 1:
                            emit(DELETE, a, empty)
                        emit(kind, a, mine)
                        if self.outer and w < 0 and others == 0:
                            emit(INSERT, a, empty)
        return (held if held["l"] or held["r"] else None), out


def join(
    left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", condition: Callable[[dict], bool] | None = None, seq: str = "seq"
) -> DataFrame:
    """Joins two streams of rows with `row_kind` (all +I where absent) and a sequence column; null keys match nothing."""
    if how not in ("inner", "left"):
        raise ValueError("a changelog join is inner or left")
    sides = []
    columns = {s: [c for c in df.columns if c not in ("row_kind", seq)] for s, df in (("l", left), ("r", right))}
    types = {f.name: f.dataType for df in (left, right) for f in df.schema}
    for side, df in (("l", left), ("r", right)):
        own = [F.col(pair[side == "r"]).cast("string") for pair in keys]
        null = F.greatest(*(F.isnull(c) for c in own), F.lit(False))
        key = F.when(~null, F.to_json(F.array(*own)))
        kind = F.col("row_kind") if "row_kind" in df.columns else F.lit(INSERT)
        other = [F.lit(None).cast(types[c]).alias(c) for c in columns["r" if side == "l" else "l"]]
        mine = [F.col(c) for c in columns[side]]
        # rows without a key match nothing: a hash of the row spreads them over tasks
        group = F.coalesce(key, F.concat(F.lit("null "), F.xxhash64(*columns[side]).cast("string")))
        sides.append(df.select(group.alias("join_group"), key.alias("join_key"), F.lit(side).alias("join_side"), kind.alias("row_kind"), F.col(seq).alias(seq), *(mine + other if side == "l" else other + mine)))
    tagged = sides[0].unionByName(sides[1])
    schema = _with_kind([T.StructField(c, types[c]) for c in columns["l"] + columns["r"]])
    names = ["join_key", "join_side", "row_kind", *columns["l"], *columns["r"]]
    return _run(tagged, ["join_group"], Join(columns["l"], columns["r"], how == "left", condition, names, seq, _kinds(schema)), schema, "append")


class Reduce(Keyed):
    """Running user reduction: the first row as it is, then function(so far, row)."""

    def __init__(self, function, *rest):
        super().__init__(*rest)
        self.function = function

    def fold(self, held, rows):
        out = []
        for row in rows:
            held = row if held is None else self.function(held, row)
            out.append(held)
        return held, out


def reduce_by_key(df: DataFrame, keys: list[str], function: Callable[[dict, dict], dict], seq: str | None = None) -> DataFrame:
    return _run(df, keys, Reduce(function, df.columns, seq, _kinds(df.schema)), df.schema, "append")


_JSON = T.StructType([T.StructField("json", T.StringType())])


class ValueCell:
    """One value of a key, anything that JSON can hold."""

    def __init__(self, handle, name: str, ttl_ms: int | None):
        self.state = handle.getValueState(name, _JSON, ttl_ms)

    def get(self, default=None):
        return json.loads(self.state.get()[0]) if self.state.exists() else default

    def set(self, value) -> None:
        self.state.update((json.dumps(value),))

    def clear(self) -> None:
        self.state.clear()


class ListCells:
    """A list of a key; an addition reads nothing."""

    def __init__(self, handle, name: str, ttl_ms: int | None):
        self.state = handle.getListState(name, _JSON, ttl_ms)

    def add(self, value) -> None:
        self.state.appendValue((json.dumps(value),))

    def all(self) -> list:
        return [json.loads(text) for (text,) in self.state.get()] if self.state.exists() else []

    def clear(self) -> None:
        self.state.clear()


class MapCells:
    """A map of a key; only the entries that are asked for are read or written."""

    def __init__(self, handle, name: str, ttl_ms: int | None):
        self.state = handle.getMapState(name, _JSON, _JSON, ttl_ms)

    def get(self, key, default=None):
        at = (json.dumps(key),)
        return json.loads(self.state.getValue(at)[0]) if self.state.containsKey(at) else default

    def put(self, key, value) -> None:
        self.state.updateValue((json.dumps(key),), (json.dumps(value),))

    def remove(self, key) -> None:
        self.state.removeKey((json.dumps(key),))

    def items(self) -> list[tuple]:
        return [(json.loads(k), json.loads(v)) for (k,), (v,) in self.state.iterator()] if self.state.exists() else []

    def clear(self) -> None:
        self.state.clear()


CELLS = {"value": ValueCell, "list": ListCells, "map": MapCells}


class Process(Keyed):
    """A user function of one input with named state and timers.

    function(key, row, state, timers) and on_timer(key, time_ms, state, timers)
    give lists of rows; key is a tuple, state maps the declared names to their
    cells, timers has `register(ms)` and `delete(ms)`.
    """

    def __init__(self, function, on_timer, state: dict[str, str], ttl_ms: int | None, *rest):
        super().__init__(*rest)
        self.function, self.on_timer, self.declared, self.ttl_ms = function, on_timer, state, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = {name: CELLS[kind](handle, name, self.ttl_ms) for name, kind in self.declared.items()}
        self.timers = Timers(handle)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True)
        if self.seq:
            frame = frame.sort_values(self.seq, kind="stable")
        out = []
        for values in frame[self.columns].itertuples(index=False):
            row = {c: _plain(v) for c, v in zip(self.columns, values, strict=True)}
            out += self.function(key, row, self.cells, self.timers) or []
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        yield self.frame(key, (self.on_timer(key, at, self.cells, self.timers) or []) if self.on_timer else [])


def process(
    df: DataFrame, keys: list[str], function: Callable, schema: T.StructType, state: dict[str, str], on_timer: Callable | None = None,
    time_mode: str = "none", ttl_ms: int | None = None, seq: str | None = None,
) -> DataFrame:
    """state: name -> `value`, `list` or `map`; time_mode: `EventTime` or `ProcessingTime` where timers are used.

    With `ttl_ms`, state that was not written for so long goes, by the clock of `ProcessingTime`.
    """
    if ttl_ms is not None and time_mode.lower() != "processingtime":
        raise ValueError("state expires by processing time only")
    return _run(df, keys, Process(function, on_timer, state, ttl_ms, df.columns, seq, _kinds(schema)), schema, "append", time_mode)


class CoProcess(StatefulProcessor):
    """A user function of two tagged inputs with shared state and timers.

    function(side, row, state, timers) and on_timer(time_ms, state, timers) give
    lists of rows; state is a dict kept per key, timers has `register(ms)` and
    `delete(ms)`.
    """

    def __init__(self, function, on_timer, schema: T.StructType):
        self.function, self.on_timer, self.names = function, on_timer, schema.names

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType([T.StructField("json", T.StringType())]))

    def _call(self, run) -> list[dict]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out = run(state)
        if state:
            self.state.update((json.dumps(state),))
        else:
            self.state.clear()
        return out

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            incoming = [{c: _plain(v) for c, v in r.items()} for r in frame.to_dict("records")]
            out = self._call(lambda state, incoming=incoming: [x for r in incoming for x in self.function(r["join_side"], r, state, Timers(self.handle)) or []])
            yield pd.DataFrame([[r.get(n) for n in self.names] for r in out], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = self._call(lambda state: self.on_timer(at, state, Timers(self.handle)) or []) if self.on_timer else []
        yield pd.DataFrame([[r.get(n) for n in self.names] for r in out], columns=self.names)

    def close(self) -> None:
        pass


class Timers:
    def __init__(self, handle):
        self.register, self.delete = handle.registerTimer, handle.deleteTimer


def co_process(
    left: DataFrame, right: DataFrame, key: str, function: Callable, schema: T.StructType, on_timer: Callable | None = None, time_mode: str = "none"
) -> DataFrame:
    """Two streams with one key column; time_mode: `EventTime` or `ProcessingTime` where timers are used."""
    both = left.withColumn("join_side", F.lit("l")).unionByName(right.withColumn("join_side", F.lit("r")), allowMissingColumns=True)
    return both.groupBy(key).transformWithStateInPandas(CoProcess(function, on_timer, schema), outputStructType=schema, outputMode="append", timeMode=time_mode)
