import heapq
from fractions import Fraction

import pytest
from brookspan.llm import mixing as M
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def handed(claims, caps, wanted, block):
    """Words of each party, block by block to the highest quotient, the last block cut."""
    heap = [(-Fraction(c), i, 1) for i, c in enumerate(claims)]
    heapq.heapify(heap)
    out = [0] * len(claims)
    while heap and wanted:
        _, i, k = heapq.heappop(heap)
        if n := min(wanted, block, caps[i] - out[i]):
            out[i] += n
            wanted -= n
            heapq.heappush(heap, (-Fraction(claims[i], 2 * k + 1), i, k + 1))
    return out


def apportioned(spark, claims, caps, wanted, block):
    df = spark.createDataFrame([(0, i, c, m, wanted) for i, (c, m) in enumerate(zip(claims, caps, strict=True))], "g int, shard long, size long, most long, wanted long")
    return [r.won for r in M.apportioned(df, ["g"], ["shard"], "size", "most", "wanted", block, "won").orderBy("shard").collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 60)), min_size=1, max_size=9), st.integers(0, 300), st.sampled_from([1, 4]))
def test_apportionment_gives_each_block_to_the_highest_quotient(spark, parties, wanted, block):
    claims, caps = [c for c, _ in parties], [m if c else 0 for c, m in parties]
    assert apportioned(spark, claims, caps, wanted, block) == handed(claims, caps, wanted, block)


@pytest.mark.parametrize(("large", "small", "seats"), [(100, 0.6, 700), (100, 0.4, 500)])
def test_many_small_parties_beside_a_large_one(spark, large, small, seats):
    claims = [int(10 * large)] + [int(10 * small)] * 1000
    got = apportioned(spark, claims, [10**6] * 1001, seats, 1)
    assert got == handed(claims, [10**6] * 1001, seats, 1) and got[0] == {700: 83, 500: 125}[seats]


@pytest.mark.parametrize("block", [1, 4])
def test_blocks_handed_on_by_a_cap_go_to_the_highest_quotient(spark, block):
    """A party's cap leaves blocks over, and a quotient beyond the first range ranked is higher than a small party's second."""
    claims, caps = [0, 0, 22, 460, 461], [0, 0, 47 * block, 11 * block, 29 * block]
    got = apportioned(spark, claims, caps, 30 * block, block)
    assert got == handed(claims, caps, 30 * block, block) == [0, 0, block, 11 * block, 18 * block]


def test_groups_are_apportioned_apart(spark):
    rows = [(g, i, 3 + (7 * i + g) % 11, 40, 50 + g) for g in range(5) for i in range(6 + g)]
    df = spark.createDataFrame(rows, "g int, shard long, size long, most long, wanted long")
    got = {(r.g, r.shard): r.won for r in M.apportioned(df, ["g"], ["shard"], "size", "most", "wanted", 4, "won").collect()}
    for g in range(5):
        own = [r for r in rows if r[0] == g]
        assert [got[g, i] for i in range(len(own))] == handed([r[2] for r in own], [r[3] for r in own], 50 + g, 4)


def test_small_source_in_many_shards_meets_its_target(spark):
    """400 words, of which each shard has about ten, are all taken twice."""
    rows = [(i, "w " * 50, "big") for i in range(400)] + [(1000 + i, "w w w w w w w w w w", "tail") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = M.mix(docs, weights=(1, 5), shard_docs=10).where("source = 'tail'").agg(F.sum("taken"), F.max("target")).first()
    assert found[1] == 800 and abs(found[0] - 800) <= 16


def test_repeated_rows_without_identifier(spark):
    """Equal rows are counted, not gathered, and the mix still has every one of them."""
    rows = [(None, "a b c", "x")] * 300 + [(None, "d e", "x")] * 50 + [(1, "f g h i", None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = M.mix(docs).collect()
    assert len(found) == 390 and all(0 <= r.taken <= 2 * r["size"] for r in found)
    for source in ("x", None):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 17


def filled(sizes, weights, total, ceiling):
    """Targets by sharing the excess again and again."""
    out, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        level = (total - sum(out[s] for s in sizes if s not in open_)) / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > ceiling * sizes[s]}
        if not full:
            return out | {s: weights[s] * level for s in open_}
        out |= {s: ceiling * sizes[s] for s in full}
        open_ -= full
    return out


def test_awkward_rows(odd_documents, no_documents):
    rows = M.mix(odd_documents).collect()
    assert len(rows) == odd_documents.count() and M.mix(no_documents).count() == 0
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = filled(sizes, dict(zip(order, [5, 2, 1, 5], strict=False)), 1.5 * sum(sizes.values()), 2.0)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16 + 1
    assert sorted(map(repr, rows)) == sorted(map(repr, M.mix(odd_documents).collect()))


def test_mixed_documents_hold_what_was_taken(odd_documents):
    docs = odd_documents.where("doc_id is not null and doc_id <> 7")
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(M.WORDS))).alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in M.mix(docs).collect() if r.taken}


def test_mixed_documents_with_shared_identifiers_and_clashing_columns(spark):
    rows = [(None, "a b c"), (None, "a b c"), (None, "d"), (2, "e f"), (2, "g h i"), (3, "j k l m")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    docs = docs.selectExpr("*", *(f"1 AS {c}" for c in ("_id", "_row", "_copies", "_part", "_cut", "_size", "rows", "place", "shard")))
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(M.WORDS)))).first()[0] == round(1.5 * 16)


def test_main_path_has_no_python(odd_documents):
    plan = M.mixed_documents(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
