"""Time windows: tumbling, hopping, cumulating, session, and aggregation over them.

Hopping and cumulating aggregation shares slices: rows are first aggregated by
the largest time span that divides both size and slide, and only those partial
results are copied into their windows, so a row is never copied itself.  The
copies are made after the last shuffle: partial results are dealt by key and
block, a stretch of many windows, and one is sent to each block that has a
window of it, which is one block for nearly all.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"ms": 1, "millisecond": 1, "s": 1000, "second": 1000, "m": 60_000, "minute": 60_000, "h": 3_600_000, "hour": 3_600_000, "d": 86_400_000, "day": 86_400_000}
MILLISECOND = "INTERVAL '0.001' SECOND"
#: A block of hopping windows is so many sizes long; a slice near its end is sent to two.
BLOCK_WINDOWS = 16


def millis(span: str) -> int:
    """Milliseconds of a span such as `10 seconds`."""
    number, unit = span.split()
    unit = unit.lower() if unit.lower() in UNITS else unit.lower().rstrip("s")
    return int(number) * UNITS[unit]


def _span(ms: int) -> str:
    return f"{ms} milliseconds"


def _interval(ms: int) -> str:
    return f"INTERVAL '{ms / 1000:.3f}' SECOND"


def _zoned(time: Column, zone: str | None) -> Column:
    return time if zone in (None, "UTC") else F.from_utc_timestamp(time, zone)


def _named(df: DataFrame, window: Column, zone: str | None) -> DataFrame:
    back = (lambda c: c) if zone in (None, "UTC") else (lambda c: F.to_utc_timestamp(c, zone))
    if taken := {"window_start", "window_end", *(["window"] if df.isStreaming else [])} & set(df.columns):
        raise ValueError(f"the input has columns that windows add: {sorted(taken)}")
    name = "window" if df.isStreaming else "_assigned_window"
    rows = df.withColumn(name, window)
    bounds = back(F.col(f"{name}.start")).alias("window_start"), back(F.col(f"{name}.end")).alias("window_end")
    # in a stream only the window itself carries the watermark, so it stays for the aggregation
    return rows.select(*df.columns, *bounds, *([name] if df.isStreaming else []))


def tumble(df: DataFrame, time: str, size: str, offset: str = "0 seconds", zone: str | None = None) -> DataFrame:
    """Adds window_start and window_end.  zone: windows are aligned to its local time."""
    return _named(df, F.window(_zoned(F.col(time), zone), size, None, offset), zone)


def hop(df: DataFrame, time: str, size: str, slide: str, offset: str = "0 seconds", zone: str | None = None) -> DataFrame:
    """A row for each window that has it."""
    return _named(df, F.window(_zoned(F.col(time), zone), size, slide, offset), zone)


def cumulate(df: DataFrame, time: str, size: str, step: str, offset: str = "0 seconds", zone: str | None = None) -> DataFrame:
    """A row for each window that has it; windows of one start grow by `step` up to `size`."""
    _divides(size, step)
    rows = tumble(df, time, step, offset, zone).withColumnRenamed("window_end", "_slice").drop("window_start")
    return _cumulated(rows, df.columns, size, step, offset)


def _divides(size: str, step: str) -> None:
    if millis(size) % millis(step):
        raise ValueError("the size is a multiple of the step")


def _cumulated(rows: DataFrame, keep: list[str], size: str, step: str, offset: str) -> DataFrame:
    whole = F.window(F.col("_slice") - F.expr(MILLISECOND), size, None, offset)
    rows = rows.withColumn("_whole", whole)
    ends = F.sequence(F.col("_slice"), F.col("_whole.end"), F.expr(f"INTERVAL '{millis(step) / 1000:.3f}' SECOND"))
    return rows.select(*keep, F.col("_whole.start").alias("window_start"), F.explode(ends).alias("window_end"))


#: How partial results of a slice merge, by the name of an aggregate: its parts, and the merged expression.
MERGES = {
    "count": (lambda x: {"n": F.count(x)}, lambda p: F.sum(p["n"])),
    "sum": (lambda x: {"s": F.sum(x)}, lambda p: F.sum(p["s"])),
    "min": (lambda x: {"m": F.min(x)}, lambda p: F.min(p["m"])),
    "max": (lambda x: {"m": F.max(x)}, lambda p: F.max(p["m"])),
    "avg": (lambda x: {"s": F.sum(x), "n": F.count(x)}, lambda p: F.call_function("div", F.sum(p["s"]), F.when(F.sum(p["n"]) > 0, F.sum(p["n"])))),
}


def _shared(sliced: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, Column]], into_blocks, into_windows) -> DataFrame:
    """Aggregates by slice, deals the parts by key and block (`into_blocks` adds `_block`), copies them into windows, merges them there."""
    parts = {n: {k: (f"_{n}_{k}", e) for k, e in MERGES[f][0](x).items()} for n, (f, x) in aggregates.items()}
    columns = [e.alias(c) for own in parts.values() for c, e in own.values()]
    partial = sliced.groupBy(*keys, "_slice").agg(*columns)
    names = [*keys, *(c for own in parts.values() for c, _ in own.values())]
    merged = [MERGES[f][1]({k: F.col(c) for k, (c, _) in parts[n].items()}).alias(n) for n, (f, _) in aggregates.items()]
    # a fixed number of partitions: adaptive execution would join them by their size before the copies
    tasks = int(sliced.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = into_blocks(partial).repartition(tasks, *keys, "_block")
    return into_windows(dealt, [*names, "_block"]).groupBy(*keys, "_block", "window_start", "window_end").agg(*merged).drop("_block")


def hop_agg(df: DataFrame, keys: list[str], time: str, size: str, slide: str, aggregates: dict[str, tuple[str, Column]], offset: str = "0 seconds") -> DataFrame:
    """Aggregates over hopping windows through shared slices.  aggregates: name -> (count, sum, min, max or avg, expression)."""
    if millis(slide) > millis(size):
        raise ValueError("the slide is no longer than the size")
    slice_ = gcd(millis(size), millis(slide))
    rows = df.withColumn("_slice", F.window(time, _span(slice_), None, offset)["end"])
    # the windows of a slice are those of its last millisecond; the latest starts in the slide that has it
    last = F.window(F.col("_slice") - F.expr(MILLISECOND), slide, None, offset)["start"]
    back = -(-millis(size) // millis(slide)) - 1
    starts = F.filter(
        F.sequence(F.col("_last") - F.expr(_interval(back * millis(slide))), F.col("_last"), F.expr(_interval(millis(slide)))),
        lambda start: start + F.expr(_interval(millis(size))) >= F.col("_slice"),
    )
    # a block starts between round times, where slices of coarse times would all lie on a border
    span = BLOCK_WINDOWS * millis(size)
    block = lambda start: F.floor((F.unix_millis(start.cast("timestamp")) + span // 2) / span)

    def into_blocks(partial: DataFrame) -> DataFrame:
        return partial.withColumn("_last", last).withColumn("_block", F.explode(F.array_distinct(F.transform(starts, block))))

    def into_windows(dealt: DataFrame, names: list[str]) -> DataFrame:
        windows = dealt.select(*names, F.explode(starts).alias("window_start")).where(block(F.col("window_start")) == F.col("_block"))
        return windows.withColumn("window_end", F.col("window_start") + F.expr(_interval(millis(size))))

    return _shared(rows, keys, aggregates, into_blocks, into_windows)


def cumulate_agg(df: DataFrame, keys: list[str], time: str, size: str, step: str, aggregates: dict[str, tuple[str, Column]], offset: str = "0 seconds") -> DataFrame:
    """Aggregates over cumulating windows through shared slices."""
    _divides(size, step)
    rows = df.withColumn("_slice", F.window(time, step, None, offset)["end"])
    whole = F.window(F.col("_slice") - F.expr(MILLISECOND), size, None, offset)["start"]
    return _shared(rows, keys, aggregates, lambda partial: partial.withColumn("_block", whole), lambda dealt, names: _cumulated(dealt, names, size, step, offset))


def window_agg(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of rows that have window_start and window_end."""
    if df.isStreaming and "window" in df.columns:
        bounds = [F.first(c).alias(c) for c in ("window_start", "window_end")]
        found = df.groupBy(*keys, "window").agg(*bounds, *(e.alias(n) for n, e in aggregates.items()))
        return found.drop("window")
    return df.groupBy(*keys, "window_start", "window_end").agg(*(e.alias(n) for n, e in aggregates.items()))


def session_agg(df: DataFrame, keys: list[str], time: str, gap: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates by session: a row less than or exactly `gap` after another of its key belongs with it."""
    found = df.groupBy(*keys, F.session_window(time, gap).alias("_s")).agg(*(e.alias(n) for n, e in aggregates.items()))
    return found.select(*keys, F.col("_s.start").alias("window_start"), F.col("_s.end").alias("window_end"), *aggregates)


def watermark(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Event time and how late rows may be; a TIMESTAMP_NTZ column is read as UTC, for Spark's watermarks need an instant."""
    if dict(df.dtypes)[time] == "timestamp_ntz":
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, delay)
