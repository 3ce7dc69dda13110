"""Exact top-k search by inner product with a forest of M-trees.

A vector x is lifted to (x, sqrt(M - |x|^2)), M the largest squared length of
all; for a query (q, 0) the Euclidean distance then falls as the inner product
rises, so nearest neighbours in a metric space are the highest scores.

The vectors are dealt into shards of about `shard_rows`.  Each shard becomes an
M-tree: pages of at most `page` entries; an entry of an inner page has a
routing object, the covering radius of its subtree, its distance to the page's
own routing object, and a child page; a leaf's entries are vectors with their
distance to the page's routing object.  Copies of a vector inside a shard are
one entry that keeps the smallest identifiers, so many that `k` are left
without any one of them, which is all that a result can need.  Pages are rows
of a table in the shared folder.

A block of queries goes through a tree best first.  With the distance from the query to a
page's routing object known, |d(q, parent) - d(entry, parent)| bounds the
distance to an entry, less its radius, before anything is computed; only
entries within the distance of the k-th result so far are computed.  Bounds
allow for rounding, and scores are integers, so the result is exact.  Lifted vectors have
one length, so a distance comes from the score itself, by one matrix product for
all queries that read a page.

Queries meet shards in blocks; each pair of a block and a shard is a task of
bounded size, and the best k of each are merged by rank.

Nulls: rows whose identifier or vector is null, or holds a null or non-finite
component, take no part.  Vectors are compared with those of their own length
only.  A query's own identifier is never its result; repeated rows with one
identifier are one candidate each.  Scores must fit a 64-bit integer.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookspan.llm.common import ship, stored

PAGE = "size int, shard long, page int, leaf boolean, objects binary, ids array<array<long>>, radii array<double>, near array<double>, children array<int>, lift double"
#: The score of a place that is not taken.
NONE = -(1 << 63) + 1


class Tree:
    """An M-tree over lifted vectors; built bottom-up in bulk or made of stored pages."""

    def __init__(self, pages: list[dict]):
        self.pages = pages

    @classmethod
    def build(cls, vectors: np.ndarray, ids: list[list[int]], lift: float, page: int, seed: int = 1) -> Tree:
        """vectors: distinct integer rows; ids: the identifiers of each."""
        random = np.random.default_rng(seed)
        points = lifted(vectors, lift)
        pages: list[dict] = []

        def radius_to(centre: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(((points[rows] - centre) ** 2).sum(axis=1), 0))

        def grow(rows: np.ndarray, centre: int) -> int:
            """The page over some rows with the routing object `centre`; gives its number."""
            number = len(pages)
            pages.append({})
            if len(rows) <= page:
                pages[number] = {"leaf": True, "rows": rows, "near": radius_to(points[centre], rows), "radii": np.zeros(len(rows)), "children": []}
                return number
            fan = min(page, -(-len(rows) // page), 16)
            seeds = rows[random.choice(len(rows), max(2, fan), replace=False)]
            distance = ((points[rows][:, None, :] - points[seeds][None, :, :]) ** 2).sum(axis=2)
            nearest = distance.argmin(axis=1)
            routing, radii, children = [], [], []
            for c in range(len(seeds)):
                own = rows[nearest == c]
                if not len(own):
                    continue
                if len(own) == len(rows):  # no seed tells them apart
                    halves = np.array_split(own, -(-len(own) // page))
                    if len(halves) > page:
                        halves = np.array_split(own, page)
                else:
                    halves = [own]
                for part in halves:
                    routing.append(seeds[c])
                    radii.append(radius_to(points[seeds[c]], part).max())
                    children.append(grow(part, seeds[c]))
            routing = np.array(routing)
            pages[number] = {"leaf": False, "rows": routing, "near": radius_to(points[centre], routing), "radii": np.array(radii), "children": children}
            return number

        everything = np.arange(len(vectors))
        middle = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        grow(everything, middle)
        for p in pages:
            p["objects"] = vectors[p["rows"]]
            p["ids"] = [ids[i] for i in p["rows"].tolist()] if p["leaf"] else []
        pages.insert(0, {"leaf": False, "objects": vectors[[middle]], "ids": [], "near": np.zeros(1), "radii": np.array([radius_to(points[middle], everything).max()]), "children": [0]})
        for p in pages:
            p["children"] = [c + 1 for c in p["children"]]
        return cls(pages)

    def search(self, query: np.ndarray, query_id: int, k: int, lift: float) -> list[tuple[int, int]]:
        """The k highest (score, id) of one query, ties to the smaller id."""
        scores, ids = self.search_block(query[None, :], np.array([query_id]), k, lift)
        return [(s, i) for s, i in zip(scores[0].tolist(), ids[0].tolist(), strict=True) if s > NONE]

    def search_block(self, queries: np.ndarray, query_ids: np.ndarray, k: int, lift: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best of each query, best first, ties to the smaller id; scores are `NONE` beyond the last.

        A page is read once for all queries that may find something in it; pages come by the least bound of any query.
        """
        own = (queries.astype(float) ** 2).sum(axis=1)
        norms = np.sqrt(own)
        slack = 1e-6 * (1 + math.sqrt(lift) + norms)
        exact = float(norms.max(initial=0.0)) * math.sqrt(lift) < 1 << 52  # sums of doubles are integers then
        columns = (queries.astype(float) if exact else queries).T
        scores = np.full((len(queries), k), NONE, np.int64)
        ids = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        limit = np.full(len(queries), math.inf)
        queue = [(0.0, 0, np.arange(len(queries)), np.zeros(len(queries)), None)]
        while queue:
            _, number, at, low, to_parent = heapq.heappop(queue)
            near_enough = low <= limit[at]
            if not near_enough.any():
                continue
            at = at[near_enough]
            p = self.pages[number]
            if "numbers" not in p:
                p["numbers"] = p["objects"].astype(float) if exact else p["objects"]
            if to_parent is None:
                open_ = np.ones((len(at), len(p["near"])), bool)
            else:  # without computing a distance
                gap = np.abs(to_parent[near_enough][:, None] - p["near"]) - p["radii"]
                open_ = gap <= (limit + slack)[at][:, None]
            entries = np.flatnonzero(open_.any(axis=0))
            if not len(entries):
                continue
            found = np.asarray(p["numbers"][entries] @ columns[:, at]).T
            open_ = open_[:, entries]
            if p["leaf"]:
                named = [p["ids"][e] for e in entries.tolist()]
                of = np.repeat(np.arange(len(entries)), [len(x) for x in named])
                new_ids = np.array([i for x in named for i in x], np.int64)
                open_ &= found >= scores[at, -1][:, None]
                open_ = open_[:, of] & (new_ids != query_ids[at][:, None])
                better = np.flatnonzero(open_.any(axis=1))
                if not len(better):
                    continue
                rows, open_ = at[better], open_[better]
                some = np.flatnonzero(open_.any(axis=0))
                open_ = open_[:, some]
                new = np.where(open_, found[better][:, of[some]].astype(np.int64), NONE)
                all_scores = np.concatenate([scores[rows], new], axis=1)
                all_ids = np.concatenate([ids[rows], np.broadcast_to(new_ids[some], new.shape)], axis=1)
                order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
                scores[rows] = np.take_along_axis(all_scores, order, axis=1)
                ids[rows] = np.take_along_axis(all_ids, order, axis=1)
                worst = scores[rows, -1]
                reach = np.sqrt(np.maximum(0.0, own[rows] + lift - 2.0 * worst)) + slack[rows]
                limit[rows] = np.where(worst > NONE, reach, math.inf)
            else:
                # all lifted vectors are as long as the longest, so the score gives the distance
                distance = np.sqrt(np.maximum(0.0, own[at][:, None] + lift - 2.0 * found))
                bound = np.maximum(0.0, distance - p["radii"][entries] - slack[at][:, None])
                open_ &= bound <= limit[at][:, None]
                for j, e in enumerate(entries.tolist()):
                    on = np.flatnonzero(open_[:, j])
                    if len(on):
                        lows = bound[on, j]
                        heapq.heappush(queue, (float(lows.min()), p["children"][e], at[on], lows, distance[on, j]))
        return scores, ids


def lifted(vectors: np.ndarray, lift: float) -> np.ndarray:
    rows = vectors.astype(float)
    return np.column_stack([rows, np.sqrt(np.maximum(0.0, lift - (rows**2).sum(axis=1)))])


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = 8192, block_queries: int = 512,
    page: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score.  is_query: a condition on the identifier column, which rows are queries."""
    spark = vectors.sparkSession
    ship(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col(id_col).isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)
    )
    whole = rows.select(
        F.col(id_col).alias("vec_id"), is_query.alias("asked"), F.size("v").alias("size"), F.transform("v", lambda x: F.floor(scale * x).cast("long")).alias("v")
    )
    whole = stored(whole, "mtree-vectors")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    numbers = whole.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asked").cast("long")).alias("asked"), F.max(length).alias("lift")).first()
    shards = max(1, math.ceil(numbers["n"] / shard_rows))
    blocks = max(1, math.ceil((numbers["asked"] or 0) / block_queries))
    lift = float(numbers["lift"] or 0.0)
    dealt = whole.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))

    def build(group: pa.Table) -> pa.Table:
        size, shard = group.column("size")[0].as_py(), group.column("shard")[0].as_py()
        ids = group.column("vec_id").to_numpy()
        matrix = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        distinct, of = np.unique(matrix[order], axis=0, return_inverse=True) if size else (matrix[:1], np.zeros(len(ids), int))
        named: list[list[int]] = [[] for _ in range(len(distinct))]
        most = [0] * len(distinct)  # rows of the most frequent identifier among those kept
        for i, d in zip(ids[order].tolist(), np.ravel(of).tolist(), strict=True):
            same = named[d].count(i)
            if same < k and len(named[d]) - most[d] < k:
                named[d].append(i)
                most[d] = max(most[d], same + 1)
        tree = Tree.build(distinct, named, lift, page)
        rows = [
            {"size": size, "shard": shard, "page": n, "leaf": p["leaf"], "objects": p["objects"].astype("<i8").tobytes(), "ids": p["ids"],
             "radii": p["radii"].tolist(), "near": p["near"].tolist(), "children": p["children"], "lift": lift}
            for n, p in enumerate(tree.pages)
        ]
        types = pa.schema([
            ("size", pa.int32()), ("shard", pa.int64()), ("page", pa.int32()), ("leaf", pa.bool_()), ("objects", pa.binary()),
            ("ids", pa.list_(pa.list_(pa.int64()))), ("radii", pa.list_(pa.float64())), ("near", pa.list_(pa.float64())),
            ("children", pa.list_(pa.int32())), ("lift", pa.float64()),
        ])
        return pa.Table.from_pylist(rows, types)

    pages = stored(dealt.groupBy("size", "shard").applyInArrow(build, PAGE), "mtree-pages")
    asked = whole.where("asked").select("vec_id", "size", "v", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).alias("block"))
    trees = pages.where("page = 0").select(F.col("size").alias("q_size"), F.col("shard").alias("q_shard"))
    questions = asked.withColumnRenamed("size", "q_size").join(trees, "q_size").select(
        "q_size", "q_shard", F.col("block").alias("q_block"), F.col("vec_id").alias("q_id"), F.col("v").alias("q")
    )
    # a long as the questions' block is: the two sides meet by hash, and an int hashes otherwise
    copies = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [(), (), ()]
        if left.num_rows and right.num_rows:
            rows = sorted(left.to_pylist(), key=lambda r: r["page"])
            for r in rows:
                r["objects"] = np.frombuffer(r["objects"], "<i8").reshape(-1, r["size"]) if r["size"] else np.zeros((len(r["near"]), 0), np.int64)
                r["near"], r["radii"] = np.array(r["near"]), np.array(r["radii"])
            tree = Tree(rows)
            asked = right.column("q_id").to_numpy()
            vectors = right.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            scores, ids = tree.search_block(vectors.reshape(len(asked), rows[0]["size"]), asked, k, lift)
            at, rank = np.nonzero(scores > NONE)
            out = [asked[at], ids[at, rank], scores[at, rank]]
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    here = copies.groupBy("size", "shard", "block")
    found = here.cogroup(questions.groupBy("q_size", "q_shard", "q_block")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
