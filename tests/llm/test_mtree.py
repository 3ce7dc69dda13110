import numpy as np
import pytest
from brookspan.llm import mtree as M
from pyspark.sql import functions as F


def brute(rows, k):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in kept:
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in kept if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "page"), [(8192, 64), (40, 4)])
def test_equals_all_pairs(spark, shard, page):
    random = np.random.default_rng(shard)
    centres = random.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] * (1 + i % 3) + random.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 380)]  # copies of one vector
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (405, [0.0] * 8), (410, [1.0, 2.0]), (411, [2.0, 1.0]), (412, []), (415, [0.5]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x")).withColumn("rank", F.lit(1))
    found = M.top_k(df, F.col("vec_id") % 5 == 0, k=4, shard_rows=shard, page=page, block_queries=30)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == brute(rows, 4)
    assert M.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_many_partitions_and_repeated_identifiers(spark):
    """Blocks of queries meet every shard wherever the two are dealt; a query's own repeated rows hide no other copy."""
    random = np.random.default_rng(1)
    rows = [(i, random.normal(size=4).tolist()) for i in range(200)]
    rows += [(200, rows[0][1])] * 9 + [(i, rows[0][1]) for i in range(201, 209)] + [(207, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        found = M.top_k(df, F.col("vec_id").isin(5, 60, 115, 200), k=4, shard_rows=70, page=8, block_queries=1)
        found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    asked = sorted(set(rows_of(rows, {5, 60, 115, 200}, 4)))
    assert found == asked


def rows_of(rows, asked, k):
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    for q in asked:
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for p, a in whole if p == q for i, b in whole if i != q)
        yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k]))


def test_bounds_avoid_computations():
    random = np.random.default_rng(0)
    rows = np.unique((random.normal(size=(20, 4))[random.integers(0, 20, 4000)] * 500 + random.normal(size=(4000, 4)) * 10).astype(np.int64), axis=0)
    lift = float((rows**2).sum(axis=1).max())
    tree = M.Tree.build(rows, [[i] for i in range(len(rows))], lift, 32)
    read = []
    for p in tree.pages:
        p["objects"] = p["objects"].view(Watched)
        p["objects"].seen = read
    got = tree.search(rows[7], -1, 5, lift)
    assert [s for s, _ in got] == sorted((rows @ rows[7]).tolist(), reverse=True)[:5]
    assert sum(read) < len(rows) // 3
    for p in tree.pages:  # every entry lies within the covering radius
        assert (p["radii"] >= 0).all()


class Watched(np.ndarray):
    def __matmul__(self, other):
        self.base_seen().append(len(self))
        return np.asarray(self) @ other

    def __array_finalize__(self, parent):
        self.seen = getattr(parent, "seen", None)

    def base_seen(self):
        return self.seen
