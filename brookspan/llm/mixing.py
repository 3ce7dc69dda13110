"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

1. Every document has a size in words.  Sources get weights by their rank and
   share `share` times all words; no target exceeds `ceiling` times the words
   its source has, and what is cut off goes to the other sources by weight.
   The water level is found by a few aggregations over the sources.
2. The mix consists of blocks of `block_words` words.  The highest quotients
   target / (2 k - 1) hand the blocks out to the sources, and inside a source
   size / (2 k - 1) to its shards, so each (source, shard) has an integer quota.
   No party gets more than `ceiling` times its words: its last block may be a
   shorter one, and what it cannot take goes to the next highest quotients.
3. In a shard the documents lie in a seeded order, one after another, and are
   passed over again when the quota is not used up.  The words of the quota
   are taken from the front of this sequence.

A shard holds about `shard_docs` documents of all sources, dealt by a seeded
hash of identifier and text, so a source of any size is spread over many tasks.
Equal rows of one input split are counted before they are moved.

Nulls: a null text has size 0, a null source is a source of its own, last in
the ranking.  Rows that agree in identifier, source and text are interchangeable.  An
empty table gives an empty result; columns other than the three named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookspan.llm.common import WORDS, fresh_name, stored, text_or_empty


def running_total(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before a row in `order`, a total order.

    Rows are range-partitioned and summed inside their partition; the sums of
    the partitions before it, one row a partition, are added.
    """
    dealt = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "mix-order")
    dealt = dealt.withColumn("_chunk", F.shiftright("_at", 33))
    before = lambda window: F.coalesce(F.sum("_sum").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("_chunk").agg(F.sum(value).alias("_sum"))
    offsets = sums.select("_chunk", before(Window.orderBy("_chunk")).alias("_offset"))
    inside = dealt.withColumn("_sum", F.col(value)).withColumn(name, before(Window.partitionBy("_chunk").orderBy("_at")))
    return inside.join(F.broadcast(offsets), "_chunk").withColumn(name, F.col(name) + F.col("_offset")).drop("_at", "_chunk", "_sum", "_offset")


def apportioned(parties: DataFrame, group: list[str], order: list[str], claim: str, cap: str, wanted: str, block: int, name: str) -> DataFrame:
    """Adds `name`: the words of each party when its group's `wanted` words go out in blocks to the highest quotients claim / (2 k - 1).

    The k-th block of a party has `block` words, or what is left of its `cap`;
    ties go by `order`, and the last block is cut to what is still wanted.  Of
    n parties that share N blocks, each surely has the blocks of its exact share
    less claim / total * n / 2; a quotient can only be at stake up to as much
    above the share, or a multiple of that where caps hand blocks on.  So about
    2 n quotients are ranked for each group, whatever N is.
    """
    sums = parties.groupBy(*group).agg(
        F.sum(claim).cast("double").alias("_total"), F.count(F.lit(1)).alias("_n"), F.sum(cap).alias("_most"), F.max(wanted).alias("_wanted")
    )
    part = F.when(F.col("_total") > 0, F.col(claim) / F.col("_total")).otherwise(0.0)
    share, slack = part * F.col("_wanted") / block, part * (F.col("_n") + 1) / 2
    blocks = F.ceil(F.col(cap) / block)

    def words(seats: Column) -> Column:
        return F.least(F.col(cap), block * seats)

    low = F.least(blocks, F.greatest(F.lit(0), F.floor(share - slack + 0.5) - 1)).cast("long")
    ready = stored(parties.join(sums, group).withColumn("_low", low).withColumn("_share", share).withColumn("_slack", slack), "mix-parties")
    reach = 1
    while True:
        high = F.least(blocks, F.floor(F.col("_share") + reach * F.col("_slack") + 0.5) + 1).cast("long")
        # the blocks above the highest quotient left out must be enough, else that one could have been among the winners
        out = ready.groupBy(*group).agg(F.max(F.when(high < blocks, F.col(claim) / (2 * high + 1).cast("double"))).alias("_out"))
        above = F.when(F.col("_out") > 0, F.least(high, F.ceil((F.col(claim) / F.col("_out") + 1) / 2 * (1 - 1e-12)) - 1)).otherwise(high)
        short = ready.join(out, group).groupBy(*group).agg(
            F.sum(words(F.greatest(above, F.col("_low")))).alias("_reach"), F.least(F.max("_wanted"), F.max("_most")).alias("_needed")
        )
        if short.where("_reach < _needed").isEmpty():
            break
        reach *= 4
    given = ready.groupBy(*group).agg(F.sum(words(F.col("_low"))).alias("_given"))
    staked = ready.where(F.col("_low") < high).select(
        *group, *order, claim, cap, "_wanted", F.explode(F.sequence(F.col("_low") + 1, high)).alias("_k")
    )
    staked = staked.withColumn("_quotient", F.col(claim) / (2 * F.col("_k") - 1).cast("double")).withColumn(
        "_words", words(F.col("_k")) - words(F.col("_k") - 1)
    )
    placed = running_total(staked, [*group, F.desc("_quotient"), *order, "_k"], "_words", "_before")
    placed = placed.join(placed.groupBy(*group).agg(F.min("_before").alias("_first")), group).join(given, group)
    left = F.col("_wanted") - F.col("_given") - (F.col("_before") - F.col("_first"))
    won = placed.groupBy(*group, *order).agg(F.sum(F.greatest(F.lit(0), F.least(F.col("_words"), left))).alias("_won"))
    return ready.join(won, [*group, *order], "left").select(
        *parties.columns, (words(F.col("_low")) + F.coalesce("_won", F.lit(0))).cast("long").alias(name)
    )


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """Adds `target` to the sources (null_source, source_key, source_size)."""
    placed = running_total(sources.withColumn("_one", F.lit(1)), ["null_source", "source_key"], "_one", "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    ready = stored(placed.select("null_source", "source_key", "source_size", weight.alias("_weight")), "mix-weights")
    cap = ceiling * F.col("source_size")
    full = cap / F.col("_weight")
    total, level, held = share * (ready.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:  # the level rises, and the sources that are full at it become more, until none is added
        under, of, n = ready.agg(
            F.sum(F.when(full <= level, F.col("source_size"))), F.sum(F.when(full > level, F.col("_weight"))), F.count(F.when(full <= level, 1))
        ).first()
        if n == held or not of:
            break
        level, held = (total - ceiling * (under or 0)) / of, n
    return ready.select(
        "null_source", "source_key", "source_size", F.least(cap, F.col("_weight") * F.lit(level if of else math.inf)).alias("target")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    ceiling: float = 2.0,
    block_words: int = 16,
    shard_docs: int = 4096,
    seed: int = 20,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, and the words of its last, partial copy.

    `taken` counts words with repeats; `copies` full copies and `part` words of
    another one make it up.  See the module's description.
    """
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(text_or_empty(text_col))))
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).isNull().alias("null_source"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            place.alias("place"),
            F.spark_partition_id().alias("split"),
        ),
        "mix-sizes",
    )
    shards = max(1, math.ceil(sized.count() / shard_docs))
    key = ["null_source", "source_key"]
    dealt = (
        sized.groupBy("doc_id", *key, "size", "place", "split")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("shard", F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % shards)
    )
    cells = stored(dealt.groupBy(*key, "shard").agg(F.sum(F.col("size") * F.col("rows")).alias("shard_size")), "mix-cells")
    wanted = targets(cells.groupBy(*key).agg(F.sum("shard_size").alias("source_size")), weights, share, ceiling)
    most = F.floor(ceiling * F.col("source_size")).cast("long")
    there, room = wanted.agg(F.sum("source_size"), F.sum(most)).first()
    all_words = min(math.floor(share * (there or 0)), room or 0)  # the whole words of the targets' sum
    wanted = wanted.withColumn("whole", F.lit(0)).withColumn("most", most).withColumn("wanted", F.lit(all_words).cast("long"))
    wanted = apportioned(wanted, ["whole"], key, "target", "most", "wanted", block_words, "source_quota")
    shares = cells.join(wanted.select(*key, "source_size", "target", "source_quota"), key)
    shares = shares.withColumn("most", F.floor(ceiling * F.col("shard_size")).cast("long"))
    quotas = apportioned(shares, key, ["shard"], "shard_size", "most", "source_quota", block_words, "quota")
    quotas = quotas.select(*key, "shard", "shard_size", "source_size", "target", "quota")
    laid = Window.partitionBy(*key, "shard").orderBy("place", "doc_id", "size", "split")
    mass = F.col("size") * F.col("rows")
    copies = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.greatest(F.col("shard_size"), F.lit(1)))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - copies * F.col("shard_size") - F.col("before")))
    return (
        dealt.withColumn("before", F.sum(mass).over(laid.rowsBetween(Window.unboundedPreceding, 0)) - mass)
        .join(quotas, [*key, "shard"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
        .withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
        .select(
            "doc_id",
            F.when(~F.col("null_source"), F.col("source_key")).alias("source"),
            "size",
            "source_size",
            "target",
            (copies * F.col("size") + part).alias("taken"),
            F.when(part == F.col("size"), copies + 1).otherwise(copies).alias("copies"),
            F.when(part == F.col("size"), 0).otherwise(part).cast("long").alias("part"),
        )
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix with their own columns: full copies, and a part cut after its last word.

    The part's words are separated by single blanks.  Documents of size 0 and
    those that the mix does not take are left out.  Where identifiers are null
    or repeated, rows are told apart by a number of their own.
    """
    own, text = docs.columns, parameters.get("text_col", "text")
    key = parameters.pop("id_col", "doc_id")
    if not docs.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | F.col(key).isNull()).isEmpty():
        docs, key = stored(docs.withColumn(row := fresh_name(docs, "_row"), F.monotonically_increasing_id()), "mix-numbered"), row
    id_, copies, part, cut_ = (fresh_name(docs, name) for name in ("_id", "_copies", "_part", "_cut"))
    taken = mix(docs, id_col=key, **parameters).where(F.col("taken") > 0)
    taken = taken.select(F.col("doc_id").alias(id_), F.col("copies").alias(copies), F.col("part").alias(part))
    pieces = F.concat(
        F.array_repeat(F.lit(False), F.col(copies).cast("int")),
        F.array_repeat(F.lit(True), (F.col(part) > 0).cast("int")),
    )
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.col(part)).cast("int")), " ")
    joined = docs.join(taken, docs[key] == taken[id_]).withColumn(cut_, F.explode(pieces))
    return joined.select(*(F.when(F.col(cut_), cut).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in own))
