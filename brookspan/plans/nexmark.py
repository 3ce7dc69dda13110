"""The auction benchmark's queries q0 to q22 without q6, over tables person, auction and bid.

Each takes a dict of tables and gives the final result of the continuous query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookspan import functions as B
from brookspan.operators import aggregation, calc, joins, ranking, windows

Tables = dict[str, DataFrame]


def q0(t: Tables) -> DataFrame:
    return t["bid"].select("auction", "bidder", "price", "dateTime", "extra")


def q1(t: Tables) -> DataFrame:
    price = (F.lit("0.908").cast("decimal(4,3)") * F.col("price").cast("decimal(19,0)")).cast("decimal(23,3)")
    return calc.calc(t["bid"], {"auction": "auction", "bidder": "bidder", "price": price, "dateTime": "dateTime", "extra": "extra"})


def q2(t: Tables) -> DataFrame:
    return calc.calc(t["bid"], {"auction": "auction", "price": "price"}, "auction % 123 = 0")


def q3(t: Tables) -> DataFrame:
    sellers = t["person"].where(F.col("state").isin("OR", "ID", "CA")).select(F.col("id").alias("person"), "name", "city", "state")
    items = t["auction"].where("category = 10").select("id", "seller")
    return joins.join(items, sellers, [("seller", "person")]).select("name", "city", "state", "id")


def _closed(t: Tables) -> DataFrame:
    """Bids in their auction's time."""
    items = t["auction"].select("id", "seller", "category", "expires", F.col("dateTime").alias("opens"), "itemName")
    bids = t["bid"].select("auction", "bidder", "price", F.col("dateTime").alias("placed"), F.col("extra").alias("bid_extra"))
    return joins.join(items, bids, [("id", "auction")], condition=bids.placed.between(items.opens, items.expires))


def q4(t: Tables) -> DataFrame:
    best = aggregation.group_agg(_closed(t), ["id", "category"], {"final": B.max_("price")})
    return aggregation.group_agg(best, ["category"], {"mean": B.avg("final")})


def q5(t: Tables) -> DataFrame:
    counts = windows.hop_agg(t["bid"], ["auction"], "dateTime", "10 seconds", "2 seconds", {"num": ("count", F.lit(1))})
    # ranks with ties: a task keeps its own best of a window before the shuffle
    best = F.rank().over(Window.partitionBy("window_start", "window_end").orderBy(F.desc("num")))
    return counts.withColumn("_best", best).where("_best = 1").select("auction", "num", "window_start", "window_end")


def q7(t: Tables) -> DataFrame:
    rows = windows.tumble(t["bid"], "dateTime", "10 seconds")
    most = windows.window_agg(rows, [], {"most": B.max_("price")}).withColumnsRenamed({"window_start": "right_window_start", "window_end": "right_window_end"})
    return joins.window_join(rows, most, [("price", "most")]).select("auction", "bidder", "price", "dateTime")


def q8(t: Tables) -> DataFrame:
    people = windows.window_agg(windows.tumble(t["person"], "dateTime", "10 seconds"), ["id", "name"], {"n": B.count()})
    sellers = windows.window_agg(windows.tumble(t["auction"], "dateTime", "10 seconds"), ["seller"], {"m": B.count()})
    sellers = sellers.withColumnsRenamed({"window_start": "right_window_start", "window_end": "right_window_end"})
    return joins.window_join(people, sellers, [("id", "seller")]).select("id", "name", "window_start")


def q9(t: Tables) -> DataFrame:
    best = ranking.top_1(_closed(t), ["id"], [("price", False), ("placed", True)], seq="bidder")
    return best.select("id", "itemName", "seller", "category", "auction", "bidder", "price", "placed")


def q10(t: Tables) -> DataFrame:
    """Bids with the columns of their partition in a file sink."""
    return t["bid"].select("auction", "bidder", "price", "dateTime", B.date_format("dateTime", "yyyy-MM-dd").alias("dt"), B.date_format("dateTime", "HH:mm").alias("hm"))


def q11(t: Tables) -> DataFrame:
    return windows.session_agg(t["bid"], ["bidder"], "dateTime", "10 seconds", {"n": B.count()})


def q12(t: Tables) -> DataFrame:
    """Bids of a bidder by ten seconds of wall clock, which a batch reads once."""
    rows = t["bid"].withColumn("at", B.proctime())
    return windows.window_agg(windows.tumble(rows, "at", "10 seconds"), ["bidder"], {"n": B.count()})


def q13(t: Tables) -> DataFrame:
    side = t["side_input"].select(F.col("key").alias("side_key"), "value")
    bids = t["bid"].withColumn("key", F.pmod("auction", F.lit(10000)))
    return joins.lookup_join(bids, side, ("key", "side_key")).select("auction", "bidder", "price", "dateTime", "value")


def q14(t: Tables) -> DataFrame:
    hour = F.hour("dateTime")
    kind = F.when((hour >= 8) & (hour <= 18), "dayTime").when((hour <= 6) | (hour >= 20), "nightTime").otherwise("otherTime")
    price = (F.lit("0.908").cast("decimal(4,3)") * F.col("price").cast("decimal(19,0)")).cast("decimal(23,3)")
    rows = t["bid"].withColumn("dear", price).where((F.col("dear") > 1_000_000) & (F.col("dear") < 50_000_000))
    return calc.calc(rows, {"auction": "auction", "bidder": "bidder", "price": "dear", "bidTimeType": kind, "dateTime": "dateTime", "c_counts": B.count_char("extra", "c")})


def _ranges(prefix: str = "") -> dict:
    p = F.col("price")
    steps = {"rank1": p < 10_000, "rank2": (p >= 10_000) & (p < 1_000_000), "rank3": p >= 1_000_000}
    return {f"{prefix}{name}": where for name, where in steps.items()}


def _distinct(bids: DataFrame, keys: list[str]) -> DataFrame:
    """Bidders and auctions by key, of all bids and by range of price."""
    return aggregation.distinct_counts(bids, keys, ["bidder", "auction"], {"total": None} | _ranges(), lambda where, what: f"{where}_{what}s")


def q15(t: Tables) -> DataFrame:
    bids = t["bid"].withColumn("day", B.date_format("dateTime", "yyyy-MM-dd"))
    aggs = {"total_bids": B.count()} | {f"{n}_bids": B.count(where=w) for n, w in _ranges().items()}
    return aggregation.beside(aggregation.group_agg(bids, ["day"], aggs), _distinct(bids, ["day"]), ["day"])


def q16(t: Tables) -> DataFrame:
    bids = t["bid"].withColumn("day", B.date_format("dateTime", "yyyy-MM-dd"))
    minute = F.max(F.hour("dateTime") * 60 + F.minute("dateTime"))  # a number: text would be sorted
    aggs = {"minute": minute, "total_bids": B.count()} | {f"{n}_bids": B.count(where=w) for n, w in _ranges().items()}
    plain = aggregation.group_agg(bids, ["channel", "day"], aggs)
    plain = plain.withColumn("minute", F.format_string("%02d:%02d", F.floor(F.col("minute") / 60), F.col("minute") % 60))
    return aggregation.beside(plain, _distinct(bids, ["channel", "day"]), ["channel", "day"])


def q17(t: Tables) -> DataFrame:
    aggs = {"total_bids": B.count()} | {f"{n}_bids": B.count(where=w) for n, w in _ranges().items()}
    aggs |= {"min_price": B.min_("price"), "max_price": B.max_("price"), "avg_price": B.avg("price"), "sum_price": B.sum_("price")}
    return aggregation.group_agg(t["bid"].withColumn("day", B.date_format("dateTime", "yyyy-MM-dd")), ["auction", "day"], aggs)


def q18(t: Tables) -> DataFrame:
    """Each bidder's last bid on each auction."""
    return ranking.deduplicate(t["bid"], ["bidder", "auction"], "dateTime", "last", "price").select("auction", "bidder", "price", "dateTime")


def q19(t: Tables) -> DataFrame:
    found = ranking.top_n(t["bid"], ["auction"], [("price", False), ("dateTime", True)], 10, seq="bidder")
    return found.select("auction", "bidder", "price", "dateTime", "rank")


def q20(t: Tables) -> DataFrame:
    items = t["auction"].where("category = 10").select("id", "itemName", "description", "initialBid", "reserve", F.col("dateTime").alias("opens"), "expires", "seller", "category")
    return joins.join(t["bid"].drop("extra"), items, [("auction", "id")]).drop("id")


def q21(t: Tables) -> DataFrame:
    named = B.lower("channel")
    code = F.when(named == "apple", "0").when(named == "google", "1").when(named == "facebook", "2").when(named == "baidu", "3")
    found = B.coalesce(code, B.regex_extract("url", "(&|^)channel_id=([^&]*)", 2))
    return calc.calc(t["bid"].withColumn("channel_id", found), {c: c for c in ("auction", "bidder", "price", "channel", "channel_id")}, F.col("channel_id").isNotNull())


def q22(t: Tables) -> DataFrame:
    parts = {f"dir{i + 1}": B.split_index("url", "/", i + 3) for i in range(3)}
    return calc.calc(t["bid"], {c: c for c in ("auction", "bidder", "price", "channel")} | parts)


ALL = {f.__name__: f for f in (q0, q1, q2, q3, q4, q5, q7, q8, q9, q10, q11, q12, q13, q14, q15, q16, q17, q18, q19, q20, q21, q22)}
