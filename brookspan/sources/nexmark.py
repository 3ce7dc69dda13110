"""A deterministic auction benchmark: persons, auctions and bids as functions of an event number.

Of 50 events the first is a person, the next three are auctions, the rest bids.
Two thirds of the references go to a few hot keys.  Every column is an
expression of the event number, so the table is made in parallel, in any
number of partitions, and is the same each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The mix of events, first identifiers and skew of the benchmark.
PERSONS, AUCTIONS, BIDS = 1, 3, 46
FIRST_PERSON, FIRST_AUCTION, FIRST_CATEGORY = 1000, 1000, 10
HOT_AUCTION, HOT_SELLER, HOT_BIDDER = 2, 4, 4
HOT_AUCTION_SPAN, HOT_SELLER_SPAN, HOT_BIDDER_SPAN = 100, 100, 100
IN_FLIGHT_AUCTIONS, ACTIVE_PEOPLE = 100, 1000
CATEGORIES = 5
CITIES = ("Phoenix", "Los Angeles", "San Francisco", "Boise", "Portland", "Bend", "Redmond", "Seattle", "Kent", "Cheyenne")
STATES = ("AZ", "CA", "ID", "OR", "WA", "WY")
FIRST_NAMES = ("Peter", "Paul", "Luke", "John", "Saul", "Vicky", "Kate", "Julie", "Sarah", "Deiter", "Walter")
LAST_NAMES = ("Shultz", "Abrams", "Spencer", "White", "Bartels", "Walton", "Smith", "Jones", "Noris")
CHANNELS = ("Google", "Facebook", "Baidu", "Apple")
BASE_MS = 1_436_918_400_000

PERSON = ("id", "name", "emailAddress", "creditCard", "city", "state", "dateTime", "extra")
AUCTION = ("id", "itemName", "description", "initialBid", "reserve", "dateTime", "expires", "seller", "category", "extra")
BID = ("auction", "bidder", "price", "channel", "url", "dateTime", "extra")


def _draw(event: Column, what: str, n) -> Column:
    """A number from 0 to n - 1 for this event and purpose."""
    return F.pmod(F.xxhash64(event, F.lit(what)), n if isinstance(n, Column) else F.lit(n))


def _pick(event: Column, what: str, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(event, what, len(values)) + 1).cast("int"))


def _letters(event: Column, what: str, n: int) -> Column:
    return F.substring(F.translate(F.md5(F.concat(event.cast("string"), F.lit(what))), "0123456789", "ghijklmnop"), 1, n)


def events(spark: SparkSession, n: int, per_second: int = 1000, partitions: int | None = None) -> DataFrame:
    """The wide table: event_type (0 person, 1 auction, 2 bid) and three groups of columns, two of them null."""
    rows = spark.range(0, n, 1, partitions or max(1, spark.sparkContext.defaultParallelism))
    e = F.col("id")
    epoch, rest = F.floor(e / 50), F.pmod(e, F.lit(50))
    kind = F.when(rest < PERSONS, 0).when(rest < PERSONS + AUCTIONS, 1).otherwise(2)
    time = F.timestamp_millis(F.lit(BASE_MS) + F.floor(e * 1000 / per_second)).cast("timestamp_ntz")
    last_person = epoch * PERSONS + F.least(rest, F.lit(PERSONS - 1))
    last_auction = epoch * AUCTIONS + F.when(rest < PERSONS, -1).otherwise(F.least(rest - PERSONS, F.lit(AUCTIONS - 1)))
    last_auction = F.greatest(last_auction, F.lit(0))

    def person(what: str, hot: int, span: int) -> Column:
        active = F.least(last_person + 1, F.lit(ACTIVE_PEOPLE))
        cold = last_person - _draw(e, what + " cold", active)
        return F.when(_draw(e, what, hot) > 0, F.floor(last_person / span) * span).otherwise(cold) + FIRST_PERSON

    in_flight = F.least(last_auction + 1, F.lit(IN_FLIGHT_AUCTIONS))
    auction = F.when(_draw(e, "auction", HOT_AUCTION) > 0, F.floor(last_auction / HOT_AUCTION_SPAN) * HOT_AUCTION_SPAN).otherwise(
        last_auction - _draw(e, "auction cold", in_flight)
    ) + FIRST_AUCTION
    price = F.floor(F.pow(F.lit(10.0), _draw(e, "price", 6000) / 1000.0) * 100).cast("bigint")
    channel = F.when(_draw(e, "hot channel", 2) > 0, _pick(e, "channel", CHANNELS)).otherwise(F.concat(F.lit("channel-"), _draw(e, "cold channel", 10000).cast("string")))
    url = F.concat(
        F.lit("https://www.nexmark.com/"), _letters(e, "a", 5), F.lit("/"), _letters(e, "b", 5), F.lit("/"), _letters(e, "c", 5), F.lit("/item.htm?query=1"),
        F.when(channel.startswith("channel-"), F.concat(F.lit("&channel_id="), F.regexp_replace(channel, "channel-", ""))).otherwise(F.lit("")),
    )
    extra = _letters(e, "extra", 20)
    name = F.concat_ws(" ", _pick(e, "first", FIRST_NAMES), _pick(e, "last", LAST_NAMES))
    card = F.concat_ws(" ", *(F.lpad(_draw(e, f"card{i}", 10000).cast("string"), 4, "0") for i in range(4)))
    first_bid = F.floor(F.pow(F.lit(10.0), _draw(e, "initial", 6000) / 1000.0) * 100).cast("bigint")
    made = {
        0: dict(zip(PERSON, (last_person + FIRST_PERSON, name, F.concat(_letters(e, "m", 7), F.lit("@"), _letters(e, "d", 5), F.lit(".com")), card,
                             _pick(e, "city", CITIES), _pick(e, "state", STATES), time, extra), strict=True)),
        1: dict(zip(AUCTION, (last_auction + FIRST_AUCTION, _letters(e, "item", 20), _letters(e, "description", 32), first_bid, first_bid + price, time,
                              time + F.make_dt_interval(secs=_draw(e, "expires", 30) + 1), person("seller", HOT_SELLER, HOT_SELLER_SPAN),
                              FIRST_CATEGORY + _draw(e, "category", CATEGORIES), extra), strict=True)),
        2: dict(zip(BID, (auction, person("bidder", HOT_BIDDER, HOT_BIDDER_SPAN), price, channel, url, time, extra), strict=True)),
    }
    prefix = {0: "person", 1: "auction", 2: "bid"}
    groups = [F.when(kind == k, F.struct(*(c.alias(name) for name, c in own.items()))).alias(prefix[k]) for k, own in made.items()]
    return rows.select(e.alias("event_id"), kind.cast("int").alias("event_type"), *groups)


def tables(wide: DataFrame) -> dict[str, DataFrame]:
    """person, auction and bid of the wide table."""
    return {name: wide.where(F.col("event_type") == k).select(f"{name}.*") for k, name in enumerate(("person", "auction", "bid"))}


def join_pairs(spark: SparkSession, keys: int, left: int, right: int, most_delay_ms: int, seed: int = 0) -> DataFrame:
    """Two-sided random rows for joins: side, key, value and time, so many of each side for each key."""
    rows = spark.range(keys * (left + right)).select(F.floor(F.col("id") / (left + right)).alias("key"), F.pmod(F.col("id"), F.lit(left + right)).alias("i"), "id")
    at = F.timestamp_millis(F.lit(BASE_MS) + F.col("key") * 10 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most_delay_ms)))
    return rows.select(F.when(F.col("i") < left, "left").otherwise("right").alias("side"), "key", F.col("id").alias("value"), at.cast("timestamp_ntz").alias("time"))
