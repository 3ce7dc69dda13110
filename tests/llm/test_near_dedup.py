import math
import random

import numpy as np
import pytest
from brookspan.llm import near_dedup as N


def brute(rows, percent):
    sets = {}
    for i, t in rows:
        words = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    reach = {i: i for i in sets}

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                reach[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_awkward_rows(odd_documents, no_documents, percent):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id is not None]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(odd_documents, percent=percent).collect() if r.doc_id is not None}
    assert got == brute(rows, percent)
    assert N.near_duplicates(no_documents, percent=percent).count() == 0
    assert [(r.component_id, r.kept) for r in N.near_duplicates(odd_documents).where("doc_id is null").collect()] == [(None, False)]


def test_a_family_with_chains_and_small_parts(spark, monkeypatch):
    """Neighbours in a chain are linked, distant ones are not; buckets are larger than a part."""
    monkeypatch.setattr(N, "CHUNK", 6)
    monkeypatch.setattr(N, "PARTNERS", 3)
    source = random.Random(5)
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(source.choice([1, 1, 2, 4])):
            words[source.randrange(200)] = f"v{source.randrange(10**6)}"
    source.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, percent=85).collect()}
    assert got == brute(rows, 85)
    assert 1 < len({c for _, c, _ in got.values()}) < 60


def test_minimum_and_maximum_estimate_the_similarity():
    random_ = np.random.default_rng(1)
    a, b = random_.integers(0, 2**63, 1000).astype(np.uint64), random_.integers(0, 2**63, 1000).astype(np.uint64)
    both = random_.integers(0, 2**63, 1000).astype(np.uint64)
    x, y = (N.signature(np.unique(np.concatenate([both, z])), 512) for z in (a, b))
    share = np.mean([np.mean(p == q) for p, q in zip(x, y, strict=True)])
    assert abs(share - 1 / 3) < 0.06


def test_bands_for_thresholds():
    assert N.bands_for(85) == 16 and N.bands_for(80) > N.bands_for(85) and N.agreeing_for(85) < 0.85 * 64
    assert (1 - 0.3**4) ** N.bands_for(30) <= N.MISSED


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 99])
def test_sketches_of_a_pair_at_the_threshold_hardly_ever_disagree(percent):
    n, least, j = 2 * N.BAND * N.bands_for(percent), N.agreeing_for(percent), percent / 100
    assert sum(math.comb(n, k) * j**k * (1 - j) ** (n - k) for k in range(least)) <= N.MISSED / 10


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = dict(N.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(1, 41)} == {0} and got[101] == got[102] == 100


def test_kept_rows(odd_documents):
    kept = N.without_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns and 0 in {r.doc_id for r in kept.collect()} and 5 not in {r.doc_id for r in kept.collect()}


def test_null_and_shared_identifiers_keep_one_row_of_each_group(spark):
    text = lambda k, extra="": " ".join(f"{k}{i}" for i in range(60)) + extra
    rows = [(None, text("a")), (None, text("a", " more")), (None, text("b")), (None, text("c")), (1, text("c", " more")), (7, text("d")), (7, text("e")), (3, text("e", " more"))]
    kept = {tuple(r) for r in N.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(kept) == 5
    assert {(None, text("b")), (1, text("c", " more")), (7, text("d")), (3, text("e", " more"))} < kept
