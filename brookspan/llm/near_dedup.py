"""Near duplicates by min-max hashing, with every link confirmed on the full shingle sets.

1. A text's set: its distinct shingles of `words` words as 64-bit hashes.  Texts
   with equal sets form a class; only its smallest identifier goes on.
2. Linear permutations give two values each, the minimum and the maximum, which
   agree between two sets with probability J and nearly independently, so half
   the hash evaluations give the usual signature with less variance.  A band
   joins both values of `BAND` permutations.  There are as many bands as make
   it less likely than `MISSED` that two sets at the threshold share none (16
   for J = 0.85, 22 for 0.8).  One byte of each value is kept as a sketch.
3. Buckets are worked through in parts of at most `CHUNK` members.  A pair is a
   candidate if its sketches agree in as many places as a pair at the threshold
   does but with a probability of `UNLIKE` at most, and its sizes allow a link.  First each member is
   paired with its likeliest candidate only; the confirmed links give
   components.  Then every candidate pair between different components is
   compared, parts of buckets that hold a single component never being met with
   themselves.  So no pair that could join components is left out, and groups of
   copies cost one confirmation a member rather than one a pair.
4. Links are confirmed on the two texts' whole sets.  In the first step the texts
   are sent to tasks that stream the partners of one text at a time; in the
   second the sets go with the members of the parts.
5. Components come from alternating large-star and small-star steps on tables in
   the shared folder, none of which reaches the driver.

A low threshold needs many bands, and as many as it needs are used.

Nulls: a null text is empty.  A text without words has an empty set and is
linked with nothing.  A row with a null identifier keeps a null component and is
not kept, but `without_near_duplicates` numbers such rows.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookspan.llm.common import fresh_name, mapped, ship, slices, stored, text_or_empty

BAND = 2
#: Probability with which a pair at the threshold may share no band, and with which its sketches may agree too seldom.
MISSED, UNLIKE = 1e-5, 1e-6
CHUNK = 1024
#: Shingles that count as one member of a part.
SHINGLES = 1500
#: Partners of one text that a task streams.
PARTNERS = 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def bands_for(percent: int) -> int:
    """How many bands two sets at the threshold need."""
    shared = (percent / 100) ** (2 * BAND)
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-shared))) if percent < 100 else 1


def agreeing_for(percent: int) -> int:
    """In how many places of their sketches two sets at the threshold agree at least."""
    n, j = 2 * BAND * bands_for(percent), percent / 100
    seldom = 0.0
    for least in range(n):  # the exact binomial tail: less than `least` places agree with probability `seldom`
        seldom += math.comb(n, least) * j**least * (1 - j) ** (n - least)
        if seldom > UNLIKE:
            return max(1, least)
    return n


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = {word: xxhash.xxh64_intdigest(word) for word in set(found)}
    codes = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(codes))
    out = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - width + 1 + k]
    return np.unique(_mixed(out))


@functools.cache
def _factors(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """The odd factors and the summands of the linear permutations, as columns."""
    factors = np.random.default_rng(9).integers(1 << 62, 1 << 64, permutations, dtype=np.uint64, endpoint=False) | np.uint64(1)
    return factors[:, None], np.random.default_rng(10).integers(0, 1 << 64, permutations, dtype=np.uint64, endpoint=False)[:, None]


def signature(values: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each permutation."""
    factors, summands = _factors(permutations)
    low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(permutations, np.uint64)
    for at in range(0, len(values), 4096):
        seen = values[at : at + 4096] * factors + summands
        low = np.minimum(low, seen.min(axis=1))
        high = np.maximum(high, seen.max(axis=1))
    return low, high


def features(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_hash, bands and sketch of every row."""
    bands = bands_for(percent)
    permutations = bands * BAND
    salts = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, sets, keys, sketches = [], [], [], []
        for text in batch.column(1).to_pylist():
            values = shingles(text, words)
            sizes.append(len(values))
            sets.append(xxhash.xxh3_128_digest(values.tobytes()))
            if len(values):
                low, high = signature(values, permutations)
                both = _mixed(np.concatenate([low, high]))
                mixed = salts.copy()
                for k in range(BAND):
                    mixed = _mixed(mixed + both[:permutations].reshape(bands, BAND)[:, k])
                    mixed = _mixed(mixed + both[permutations:].reshape(bands, BAND)[:, k])
                keys.append(mixed.view(np.int64))
                sketches.append((both & np.uint64(255)).astype(np.uint8).tobytes())
            else:
                keys.append(np.zeros(0, np.int64))
                sketches.append(b"")
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            ["doc_id", "n_shingles", "set_hash", "bands", "sketch"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return mapped(rows, describe, "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary")


def _runs(batches, keys: int):
    """Streams rows sorted by their first `keys` columns as (key, columns of the whole run)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if last is not None and mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield last, pa.Table.from_batches(held)
                held, start = [], i
            last = mark
        held.append(batch.slice(start))
    if held:
        yield last, pa.Table.from_batches(held)


def _agreement(sketches: np.ndarray, others: np.ndarray, sizes: np.ndarray, other_sizes: np.ndarray, percent: int) -> np.ndarray:
    """In how many places the sketches of pairs of rows agree; 0 for pairs that are no candidates."""
    out, least = np.zeros((len(sketches), len(others)), np.int16), agreeing_for(percent)
    for i in range(len(sketches)):
        small, large = np.minimum(sizes[i], other_sizes), np.maximum(sizes[i], other_sizes)
        agree = (sketches[i] == others).sum(axis=1)
        out[i] = np.where((agree >= least) & (100 * small >= percent * large), agree, 0)
    return out


def _columns(run: pa.Table, *names: str) -> list[np.ndarray]:
    return [
        np.frombuffer(b"".join(run.column(n).to_pylist()), np.uint8).reshape(run.num_rows, -1) if n == "sketch" else run.column(n).to_numpy()
        for n in names
    ]


def first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """members: key, part, rep, n_shingles, sketch.  Each member with the likeliest candidate before it in its part of a bucket."""

    def pair(batches):
        for _, run in _runs(batches, 2):
            rep, sizes, sketches = _columns(run, "rep", "n_shingles", "sketch")
            order = np.argsort(rep)
            rep, sizes, sketches = rep[order], sizes[order], sketches[order]
            a, b = [], []
            for i in range(1, len(rep)):
                found = _agreement(sketches[i : i + 1], sketches[:i], sizes[i : i + 1], sizes[:i], percent)[0]
                if found[best := int(found.argmax())]:
                    a.append(rep[best])
                    b.append(rep[i])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = members.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(pair, "a long, b long").distinct()


def crossing_links(members: DataFrame, percent: int) -> DataFrame:
    """members: key, left, right, side, rep, n_shingles, sketch, component, bands, ids.

    The links between components that the candidates of two parts of a bucket
    confirm, a spanning forest of them.  A pair is looked at in the first band
    that it shares, and compared on whole sets unless its components have been
    joined here already, so nothing is made for the pairs that are no links.
    """

    def link(batches):
        for (key, left, right), run in _runs(batches, 3):
            side, rep, sizes, sketches, component = _columns(run, "side", "rep", "n_shingles", "sketch", "component")
            bands = run.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
            ids = run.column("ids")
            own = int(np.flatnonzero(bands[0] == key)[0])
            one = np.flatnonzero(side == 0)
            two = one if left == right else np.flatnonzero(side == 1)
            agree = _agreement(sketches[one], sketches[two], sizes[one], sizes[two], percent)
            agree[component[one][:, None] == component[two][None, :]] = 0
            if left == right:
                agree[rep[one][:, None] >= rep[two][None, :]] = 0
            x, y = np.nonzero(agree)
            order = np.argsort(-agree[x, y], kind="stable")
            x, y = one[x[order]], two[y[order]]
            del agree
            joined: dict[int, int] = {}
            sets: dict[int, np.ndarray] = {}

            def root(c: int, joined=joined) -> int:
                while c in joined:
                    c = joined[c]
                return c

            a, b = [], []
            for at in range(0, len(x), 8192):
                some, others = x[at : at + 8192], y[at : at + 8192]
                here = (bands[some] == bands[others]).argmax(axis=1) == own
                for i, j in zip(some[here].tolist(), others[here].tolist(), strict=True):
                    p, q = root(int(component[i])), root(int(component[j]))
                    if p == q:
                        continue
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = np.frombuffer(ids[k].as_py(), np.uint64)
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        joined[max(p, q)] = min(p, q)
                        a.append(min(rep[i], rep[j]))
                        b.append(max(rep[i], rep[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = members.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return dealt.mapInArrow(link, "a long, b long")


def shingle_ids(docs: DataFrame, words: int) -> DataFrame:
    """docs: doc_id, text.  rep and ids, the sorted 64-bit hashes of the set, of each row."""

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(text, words).tobytes() for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "ids"])

    return mapped(docs.select("doc_id", "text"), describe, "rep long, ids binary")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b, linked of each pair; docs: doc_id, text."""
    ship(pairs.sparkSession)
    pairs = stored(pairs, "near-pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    partners = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("doc_id"), F.lit(1).alias("place"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"), F.lit(0).alias("place"))
    # a sort-merge join at every size: which texts are asked for grows with the documents
    texts = docs.hint("merge").join(partners.unionByName(heads), "doc_id").select("a", "part", "place", "doc_id", "text")

    def compare(batches):
        head, known = np.zeros(0, np.uint64), None
        for batch in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            columns = (batch.column(i).to_pylist() for i in range(5))
            for a, _, place, doc_id, text in zip(*columns, strict=True):
                values = shingles(text, words)
                if place == 0:
                    head, known = values, a
                    continue
                assert known == a, "a partner came before its head"
                common = len(np.intersect1d(head, values, assume_unique=True))
                union = len(head) + len(values) - common
                for column, x in zip(out, (a, doc_id, 100 * common >= percent * union and union > 0), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], ["a", "b", "linked"])

    dealt = texts.repartition("a", "part").sortWithinPartitions("a", "part", "place")
    return stored(dealt.mapInArrow(compare, "a long, b long, linked boolean"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) of all nodes of the links a, b."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")

    def mark(of: DataFrame):
        return tuple(of.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        turned = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(turned.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "near-edges")
        if (now := mark(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.  Links: Jaccard similarity of `percent` or more."""
    ship(docs.sparkSession)
    rows = stored(features(docs, words, percent, id_col, text_col), "near-features")
    classes = stored(
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_hash")
        .agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch"))),
        "near-classes",
    )
    narrow = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = narrow.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = stored(narrow.join(shared, "key"), "near-buckets")
    sketches = classes.select("rep", "n_shingles", "sketch")
    part = F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("members") / CHUNK))
    members = buckets.select("key", part.alias("part"), "rep").join(sketches, "rep").select("key", "part", "rep", "n_shingles", "sketch")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    checked = confirmed(first_pairs(members, percent), texts, words, percent)
    found = components(checked.where("linked").select("a", "b"))
    labelled = buckets.select("key", "rep", "n_shingles").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    mixed = labelled.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("key")
    several = stored(labelled.join(mixed, "key"), "near-mixed")
    # a part is filled by members, or by shingles where they have many
    filled = F.greatest(F.lit(1), F.ceil(F.sum(F.greatest(F.lit(1), F.col("n_shingles") / SHINGLES)))).alias("n")
    sizes = several.groupBy("key", "component").agg(filled)
    rest = sizes.where(F.col("n") < CHUNK // 2).groupBy("key").agg(F.sum("n").alias("rest"))
    plan = sizes.join(rest, "key", "left").select(
        "key", "component", F.when(F.col("n") >= CHUNK // 2, F.ceil(F.col("n") / CHUNK)).alias("own"),
        F.ceil(F.coalesce("rest", F.lit(1)) / CHUNK).alias("pools"),
    )
    # a part of a bucket: of one large component (its number, 0, 1, ...), or (-1, 0, 1, ...) a pool of small ones
    chunk = F.when(F.col("own").isNotNull(), F.struct(F.col("component").alias("c"), F.pmod(F.xxhash64("rep"), "own").alias("p"))).otherwise(
        F.struct(F.lit(-(2**63)).cast("long").alias("c"), F.pmod(F.xxhash64("component"), "pools").alias("p"))
    )
    placed = several.join(plan, ["key", "component"]).select("key", "rep", "component", chunk.alias("chunk"))
    chunks = placed.select("key", "chunk").distinct()
    pairs = chunks.select("key", F.col("chunk").alias("left")).join(chunks.select("key", F.col("chunk").alias("right")), "key")
    pairs = pairs.where("left <= right and not (left.c = right.c and left.c <> -9223372036854775808)")
    sides = pairs.select("key", "left", "right", F.lit(0).alias("side"), F.col("left").alias("chunk")).unionByName(
        pairs.where("left <> right").select("key", "left", "right", F.lit(1).alias("side"), F.col("right").alias("chunk"))
    )
    code = lambda c: F.concat_ws(":", f"{c}.c", f"{c}.p").alias(c)
    asked = texts.hint("merge").join(several.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    crossing = (
        placed.join(sides, ["key", "chunk"])
        .join(classes.select("rep", "n_shingles", "sketch", "bands"), "rep")
        .join(shingle_ids(asked, words).dropDuplicates(["rep"]), "rep")
        .select("key", code("left"), code("right"), "side", "rep", "n_shingles", "sketch", "component", "bands", "ids")
    )
    again = stored(crossing_links(crossing, percent), "near-crossing")
    if not again.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(again))
    return (
        rows.select("doc_id", "n_shingles", "set_hash")
        .join(classes.select("set_hash", "rep"), "set_hash", "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with its own columns.

    Where identifiers are null or repeated, rows are numbered in the order of
    identifier (nulls last) and text and grouped by number, so that every group
    keeps its first row.
    """
    own, row = docs.columns, fresh_name(docs, "_row")
    if not docs.groupBy(F.col(id_col)).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | F.col(id_col).isNull()).isEmpty():
        ordered = docs.orderBy(F.asc_nulls_last(id_col), F.sha2(text_or_empty(text_col), 256))
        docs, id_col = stored(ordered.withColumn(row, F.monotonically_increasing_id()), "near-numbered"), row
    kept = near_duplicates(docs, words, percent, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_ := fresh_name(docs, "_id"))).distinct()
    return docs.join(kept, F.col(id_col) == F.col(id_), "left_semi").select(*own)
