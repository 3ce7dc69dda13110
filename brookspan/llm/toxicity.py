"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words (letters, lower case) and the first 4, 5 and 6 letters of
longer words.  Which terms span the space is fitted with the rest: each pair in
`spaces` asks for a least dependence on the label (chi-square) and a least lift
(how many times as often, or as seldom, examples with the term are toxic), and
the pair with the smallest log loss in cross-validation over the learning
sample is taken.  (0, 1) is every term of three or more examples.  Terms, their
weights and neighbours all come from the other folds, so a term that is toxic
by chance shows as such.

The examples' TF-IDF vectors are stored in an inverted index in blocks of
`BLOCK` examples with the largest weight of each term in each block.  A query
visits the blocks by falling upper bound and stops when no block can hold a
better neighbour than the `neighbours` found, so the result is exact.

The vote is weighted by cosine and by how much each class was thinned in the
sample, and is smoothed with the prior; isotonic regression on the votes of the
held-out folds turns it into a probability.  A text without a term of the space
has the smoothed rate of such examples.  The nearest examples' identifiers are
the evidence.

The sample: at most `per_class` labelled rows of each class, in the order of a
hash of the identifier.  Class counts cover all labelled rows.

Ties go to the smaller identifier, and copies of an example count once, so
reruns agree.  A text of any length is read whole.

Nulls: a null text is empty.  Rows of labels with a null identifier or label
are left out; an identifier labelled more than once counts as toxic if one of
its labels is.  With no labels the score is 0 everywhere.  Other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookspan.llm.common import mapped, ship, slices, stored, text_or_empty

BLOCK = 64
#: Parts of the sample for cross-validation; copies of a text are in one part.
FOLDS = 4
#: Spaces to choose from: chi-square, from a chance of 1e-3 a term to far less, and lift.
SPACES = ((100.0, 2.0), (60.0, 2.0), (32.8, 2.0), (19.5, 2.0), (10.8, 2.0))
#: Words kept with their terms per worker.
MEMO = 100_000
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_counts(text: str) -> Counter:
    """How often each word (UTF-8, lower case) is in the text."""
    return Counter(text.lower().encode().translate(_FOLD).split())


def terms_of(word: bytes) -> list[str]:
    """The word and its beginnings."""
    text = word.decode("utf-8", "replace")
    return [text, *(f"{text[:n]}-" for n in (4, 5, 6) if len(text) > n)]


class Neighbours:
    """The index of labelled examples and the calibration."""

    def __init__(self, vocabulary: list[str], ids: np.ndarray, rows: list[dict[int, int]], toxic: np.ndarray, weight: np.ndarray, k: int):
        """rows: counts by place in the vocabulary; weight: of an example, by its class."""
        self.places = {term: i for i, term in enumerate(vocabulary)}
        self.k = k
        frequency = np.zeros(len(vocabulary))
        for row, w in zip(rows, weight, strict=True):
            for place in row:
                frequency[place] += w
        total = weight.sum()
        self.idf = np.log(1 + total / np.maximum(frequency, 1))
        self.prior = float((toxic * weight).sum() / total) if total else 0.0
        self.without = self.prior
        vectors = [self._unit(row) for row in rows]
        kept = [i for i in range(len(rows)) if rows[i]]
        kept.sort(key=lambda i: (min(vectors[i], key=lambda p: -vectors[i][p]), int(ids[i])))  # alike in a block
        self.ids, self.toxic, self.weight = ids[kept], toxic[kept], weight[kept]
        self.blocks = -(-len(kept) // BLOCK)
        gathered: list[tuple[list[int], list[float]]] = [([], []) for _ in vocabulary]
        for place, i in enumerate(kept):
            for term, w in vectors[i].items():
                gathered[term][0].append(place)
                gathered[term][1].append(w)
        self.postings, self.starts = [], []
        self.most = np.zeros((len(vocabulary), self.blocks))
        for term, (docs, weights) in enumerate(gathered):
            at = np.array(docs, np.int64)
            values = np.array(weights)
            self.postings.append((at, values))
            self.starts.append(np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK))
            np.maximum.at(self.most[term], at // BLOCK, values)
        self.steps = (np.zeros(1), np.zeros(1))

    def vote(self, counts: dict[int, int]) -> float:
        """The vote of the neighbours; not a number where there are none."""
        return self._vote(self._unit(counts))[0] if counts and len(self.ids) else np.nan

    def _unit(self, counts: dict[int, int]) -> dict[int, float]:
        values = {p: (1 + np.log(n)) * self.idf[p] for p, n in counts.items()}
        length = float(np.sqrt(sum(v * v for v in values.values()))) or 1.0
        return {p: v / length for p, v in values.items()}

    def nearest(self, query: dict[int, float], skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine, ties to the earlier place."""
        terms = np.fromiter(query, np.int64, len(query))
        weights = np.fromiter(query.values(), float, len(query))
        bounds = weights @ self.most[terms]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable").tolist():
            if bounds[block] <= 0 or len(best) == self.k and bounds[block] < best[-1][0] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for term, w in zip(terms.tolist(), weights.tolist(), strict=True):
                if self.most[term, block]:
                    docs, values = self.postings[term]
                    a, b = self.starts[term][block : block + 2]
                    scores[docs[a:b] - block * BLOCK] += w * values[a:b]
            best += [(float(scores[i]), block * BLOCK + i) for i in np.flatnonzero(scores).tolist() if block * BLOCK + i != skip]
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[self.k :]
        return best

    def _vote(self, query: dict[int, float], skip: int = -1) -> tuple[float, list[tuple[float, int]]]:
        found = self.nearest(query, skip)
        for_ = against = 0.0
        for cosine, place in found:
            if self.toxic[place]:
                for_ += cosine * self.weight[place]
            else:
                against += cosine * self.weight[place]
        smooth = 0.2
        return (for_ + smooth * self.prior) / (for_ + against + smooth), found

    def score(self, counts: dict[int, int]) -> tuple[float, list[int]]:
        if not counts or not len(self.ids):
            return self.without, []
        vote, found = self._vote(self._unit(counts))
        value = float(np.interp(vote, *self.steps)) if len(self.steps[0]) > 1 else self.prior
        return min(1.0, max(0.0, value)), [int(self.ids[place]) for _, place in found[:5]]


def dependence(a, b, bad, good):
    """Chi-square of a term that `a` of the `bad` and `b` of the `good` examples have; for arrays and columns."""
    cross = a * (good - b) - b * (bad - a)
    return (bad + good) * cross * cross / ((a + b) * (bad + good - a - b) * bad * good + 1e-9)


def in_space(space: tuple[float, float], a: np.ndarray, b: np.ndarray, bad: float, good: float) -> np.ndarray:
    """Which terms the space holds: those of three examples or more that pass both bounds."""
    chi, lift = space
    rate, other = a * (bad + good), bad * (a + b)
    return (a + b >= 3) & (a + b < bad + good) & (dependence(a, b, bad, good) >= chi) & ((rate >= lift * other) | (rate * lift <= other))


def calibrated(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray, prior: float):
    """From votes of held-out examples (not a number: no neighbour): the steps, the rate without neighbours, and the log loss."""
    none = np.isnan(votes)
    without = float(((toxic * weight)[none].sum() + prior) / (weight[none].sum() + 1))
    steps = isotonic(votes[~none], toxic[~none], weight[~none]) if not none.all() else (np.zeros(1), np.zeros(1))
    chance = np.where(none, without, np.interp(votes, *steps) if len(steps[0]) > 1 else prior)
    chance = np.clip(chance, 1e-4, 1 - 1e-4)
    return steps, without, float(-(weight * np.where(toxic > 0, np.log(chance), np.log(1 - chance))).sum() / weight.sum())


def cross_validated(
    vocabulary: list[str], folded: np.ndarray, ids: np.ndarray, rows: list[dict[int, int]], toxic: np.ndarray, weight: np.ndarray, fold: np.ndarray, k: int, spaces: tuple,
) -> Neighbours:
    """The index over the space of smallest loss.  folded: examples with each term by class (0, 1) and fold."""

    def over(space: tuple[float, float], left_out: int) -> tuple[Neighbours, dict[int, int]]:
        others = np.arange(FOLDS) != left_out
        chosen = fold != left_out
        bad, good = float((toxic[chosen] > 0).sum()), float((toxic[chosen] == 0).sum())
        held = in_space(space, folded[:, 1, others].sum(1), folded[:, 0, others].sum(1), bad, good)
        place = {int(p): n for n, p in enumerate(np.flatnonzero(held))}
        inside = [within(rows[i], place) for i in np.flatnonzero(chosen)]
        return Neighbours([vocabulary[p] for p in place], ids[chosen], inside, toxic[chosen], weight[chosen], k), place

    best: tuple | None = None
    for space in spaces:
        votes = np.full(len(rows), np.nan)
        for part in range(FOLDS):
            model, place = over(space, part)
            for i in np.flatnonzero(fold == part).tolist():
                votes[i] = model.vote(within(rows[i], place))
        prior = float((toxic * weight).sum() / weight.sum()) if len(rows) else 0.0
        steps, without, loss = calibrated(votes, toxic, weight, prior) if len(rows) else ((np.zeros(1), np.zeros(1)), 0.0, 0.0)
        if best is None or loss < best[0]:
            best = loss, space, steps, without
    model, _ = over(best[1], -1)
    model.loss, model.space, model.steps, model.without = best
    return model


def within(counts: dict[int, int], place: dict[int, int]) -> dict[int, int]:
    """The counts of the terms that `place` knows, by their new place."""
    return {place[p]: n for p, n in counts.items() if p in place}


def isotonic(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a non-decreasing map from vote to probability, by pooling adjacent violators."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # toxic weight, weight, first vote, last vote
    for i in order.tolist():
        pools.append([float(labels[i] * weight[i]), float(weight[i]), float(votes[i]), float(votes[i])])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    at, value = [], []
    for toxic, total, first, last in pools:
        at += [first, last + 1e-9]
        value += [toxic / total] * 2
    return np.array(at), np.array(value)


def learn(docs: DataFrame, labels: DataFrame, per_class: int, terms: int, neighbours: int, seed: int, spaces: tuple = SPACES) -> Neighbours:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1), those to learn from, one row an identifier."""
    spark = docs.sparkSession
    ship(spark)
    counts = {row["toxic"]: row["n"] for row in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), F.col("doc_id")
    bad_ones, good_ones = (labels.where(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (1, 0))  # each task sends so many at most
    sample = (
        docs.join(F.broadcast(bad_ones.unionByName(good_ones)), "doc_id")
        .groupBy("toxic", F.md5("text").alias("_md5"))  # a text that is copied counts once, as its smallest identifier
        .agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
        .select("doc_id", "toxic", "text", (F.crc32("_md5") % FOLDS).cast("int").alias("fold"))
    )
    sample = stored(sample, "toxicity-sample")

    def frequencies(batches):
        for batch in slices(batches, 2048, 64 << 20):
            found: Counter = Counter()
            for toxic, text, fold in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                found.update((t, toxic, fold) for t in {t for word in word_counts(text) for t in terms_of(word)})
            if found:
                columns = [*zip(*found, strict=True), found.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], ["term", "toxic", "fold", "n"])

    cells = [(c, f) for c in (0, 1) for f in range(FOLDS)]
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = sample.mapInArrow(frequencies, "term string, toxic long, fold long, n long").groupBy("term").agg(
        *[F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == f), F.col("n")).otherwise(0)).cast("double").alias(f"n{c}{f}") for c, f in cells]
    )

    def chi(left_out: int):
        a, b = (sum((F.col(f"n{c}{f}") for f in range(FOLDS) if f != left_out), F.lit(0.0)) for c in (1, 0))
        return dependence(a, b, *(F.lit(float(sum(n for (c, f), n in sizes.items() if c == which and f != left_out))) for which in (1, 0)))

    strongest = F.greatest(*[chi(f) for f in range(-1, FOLDS)])
    seen = sum((F.col(f"n{c}{f}") for c, f in cells), F.lit(0.0))
    useful = table.where(seen >= 3).withColumn("chi", strongest).where(F.col("chi") >= min(c for c, _ in spaces))
    found = useful.orderBy(F.desc("chi"), "term").limit(terms).collect()
    vocabulary = [r["term"] for r in found]
    folded = np.array([[[r[f"n{c}{f}"] for f in range(FOLDS)] for c in (0, 1)] for r in found]).reshape(-1, 2, FOLDS)
    places = spark.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [in_vocabulary(text, places.value, {}) for text in batch.column(2).to_pylist()]
        lists = [pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *lists], ["doc_id", "toxic", "fold", "places", "counts"])

    rows = mapped(sample, vectors, "doc_id long, toxic int, fold int, places array<int>, counts array<int>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    held = {c: sum(n for (which, _), n in sizes.items() if which == c) for c in (0, 1)}
    return cross_validated(
        vocabulary, folded, np.array([r["doc_id"] for r in rows], np.int64), [dict(zip(r["places"], r["counts"], strict=True)) for r in rows],
        np.array([r["toxic"] for r in rows], float), np.array([counts[r["toxic"]] / held[r["toxic"]] for r in rows]), np.array([r["fold"] for r in rows], np.int64),
        neighbours, spaces,
    )


def in_vocabulary(text: str, places: dict[str, int], memo: dict) -> dict[int, int]:
    """Counts of the text's terms by their place; memo: words already looked up."""
    out: dict[int, int] = {}
    for word, n in word_counts(text).items():
        if (known := memo.get(word)) is None:
            if len(memo) >= MEMO:
                memo.clear()
            known = memo[word] = tuple(places[t] for t in terms_of(word) if t in places)
        for place in known:
            out[place] = out.get(place, 0) + n
    return out


def fitted(docs: DataFrame, labels: DataFrame, learning: Column, per_class: int, terms: int, neighbours: int, seed: int, id_col: str, text_col: str, label_col: str):
    """The broadcast model learned from the labels that `learning`, a condition on doc_id, allows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(learning & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    return docs.sparkSession.sparkContext.broadcast(learn(rows, known, per_class, terms, neighbours, seed))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learning: Column, per_class: int = 2500, terms: int = 4096, neighbours: int = 15,
    threshold: float = 0.3, seed: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """doc_id, score, predicted, evidence.  learning: a condition on doc_id, which labels may be learned from."""
    model = fitted(docs, labels, learning, per_class, terms, neighbours, seed, id_col, text_col, label_col)

    def score(batches):
        memo: dict = {}
        for batch in slices(batches):
            found = [model.value.score(in_vocabulary(text, model.value.places, memo)) for text in batch.column(1).to_pylist()]
            columns = [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "score", "evidence"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def without_toxic(
    docs: DataFrame, labels: DataFrame, learning: Column, per_class: int = 2500, terms: int = 4096, neighbours: int = 15,
    threshold: float = 0.3, seed: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """The rows of `docs` that score below the threshold, with their own columns; no row is moved for it."""
    model = fitted(docs, labels, learning, per_class, terms, neighbours, seed, id_col, text_col, label_col)
    place = docs.columns.index(text_col)

    def keep(batches):
        memo: dict = {}
        for batch in slices(batches):
            texts = (text or "" for text in batch.column(place).to_pylist())
            clean = [model.value.score(in_vocabulary(text, model.value.places, memo))[0] < threshold for text in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
