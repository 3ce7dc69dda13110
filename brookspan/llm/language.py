"""Language identification by nearest centroids.

A text becomes a TF-IDF vector of byte trigrams (lower case, everything in
ASCII but letters read as a blank), hashed into `BUCKETS` places and scaled to
length 1.  The learned languages have up to `clusters` centroids each, found by
spherical k-means.  The prediction is the language of the centroid with the
highest cosine.  A text whose distance 1 - cosine exceeds what nearly all
learning texts of that centroid have is `rejected`.

A text of any length is counted whole, in one vector of fixed size.  Learning takes at most `per_language` texts of each language, in the order of a
hash of the identifier; only their trigram counts reach the driver.

Nulls: a text that is null or has no letter is `und` with score 0, and so is
every text when there is nothing to learn from.  Rows with a null language or
identifier are not learned from; rows with a null identifier are predicted with
`held_out` false.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookspan.llm.common import mapped

BUCKETS = 1 << 15
#: Steepness of the score, a softmax over the languages' best cosines.
SHARPNESS = 24.0
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the text's hashed byte trigrams, those of blanks only left out."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    codes = codes[codes != 0x202020]
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(17), minlength=BUCKETS)


class Centroids:
    """What was learned: idf, unit centroids, their languages and reach."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, owners: np.ndarray, languages: list[str], reach: np.ndarray):
        self.idf, self.centres, self.owners, self.languages, self.reach = idf, centres, owners, languages, reach

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        known = [i for i, text in enumerate(texts) if text and _LETTER.search(text)] if self.languages else []
        for at in range(0, len(known), 32):
            some = known[at : at + 32]
            rows = np.stack([trigram_counts(texts[i]) for i in some]).astype(np.float32) * self.idf
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
            cosines = rows @ self.centres.T
            best = np.full((len(some), len(self.languages)), -1.0)
            for language in range(len(self.languages)):
                best[:, language] = cosines[:, self.owners == language].max(axis=1)
            soft = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
            soft /= soft.sum(axis=1, keepdims=True)
            first = cosines.argmax(axis=1)
            for k, i in enumerate(some):
                language = int(best[k].argmax())
                out[i] = self.languages[language], float(soft[k, language]), bool(1 - cosines[k, first[k]] > self.reach[first[k]])
        return out


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[str], clusters: int, seed: int) -> Centroids:
    """Spherical k-means inside each language; vectors: places and counts of each text's trigrams.

    Only the texts of one language are laid out over all places at a time.
    """
    languages = sorted(set(labels))
    frequency = np.zeros(BUCKETS, np.int64)
    for places, _ in vectors:
        frequency[places] += 1
    idf = (np.log((1 + len(vectors)) / (1 + frequency)) + 0.05).astype(np.float32)
    centres, owners, reach = [], [], []
    random = np.random.default_rng(seed)
    of = np.array([languages.index(x) for x in labels])
    for language in range(len(languages)):
        mine = np.flatnonzero(of == language)
        own = np.zeros((len(mine), BUCKETS), np.float32)
        for row, i in zip(own, mine.tolist(), strict=True):
            places, counts = vectors[i]
            row[places] = counts * idf[places]
            row /= max(float(np.linalg.norm(row)), 1e-9)
        k = min(clusters, len(own))
        middle = own[random.choice(len(own), k, replace=False)]
        for _ in range(12):
            nearest = (own @ middle.T).argmax(axis=1)
            middle = np.stack([own[nearest == c].mean(axis=0) if (nearest == c).any() else middle[c] for c in range(k)])
            middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-9)
        cosines = own @ middle.T
        nearest = cosines.argmax(axis=1)
        for c in range(k):
            far = 1 - cosines[nearest == c, c]
            centres.append(middle[c])
            owners.append(language)
            reach.append(min(0.98, 1.1 * float(np.quantile(far, 0.99)) + 0.02) if len(far) else 0.98)
    return Centroids(idf, np.stack(centres), np.array(owners), languages, np.array(reach))


def learn(docs: DataFrame, per_language: int, clusters: int, seed: int) -> Centroids:
    """docs: doc_id, text, lang; those to learn from."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, counts = [], []
        for text in batch.column(1).to_pylist():
            vector = trigram_counts(text)
            places.append(np.flatnonzero(vector).astype(np.int32))
            counts.append(vector[places[-1]].astype(np.int32))
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (places, counts)]
        return pa.RecordBatch.from_arrays([batch.column(0), *lists], ["lang", "places", "counts"])

    order = Window.partitionBy("lang").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), "doc_id")
    ids = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang")
    chosen = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).drop("_n")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text")
    found = mapped(rows, count, "lang string, places array<int>, counts array<int>").toArrow()
    if not found.num_rows:
        return Centroids(np.zeros(0), np.zeros((0, 0)), np.zeros(0), [], np.zeros(0))
    labels = found.column("lang").to_pylist()
    places, counts = found.column("places"), found.column("counts")
    marks = [hashlib.md5(p.values.to_numpy().tobytes() + c.values.to_numpy().tobytes()).digest() for p, c in zip(places, counts, strict=True)]
    stable = sorted(range(len(labels)), key=lambda i: (labels[i], marks[i]))  # whatever order the rows came in
    vectors = [(places[i].values.to_numpy(), counts[i].values.to_numpy().astype(np.float32)) for i in stable]
    return fit(vectors, [labels[i] for i in stable], clusters, seed)


def identify(
    docs: DataFrame, learning, per_language: int = 250, clusters: int = 4, seed: int = 6,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """doc_id, lang_pred, score, rejected.  learning: a condition on the identifier column, which rows may be learned from."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(learn(rows.where(learning), per_language, clusters, seed))

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = model.value.predict(batch.column(1).to_pylist())
        columns = [batch.column(0), *map(pa.array, zip(*found, strict=True))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    return mapped(rows.select("doc_id", "text"), predict, "doc_id long, lang_pred string, score double, rejected boolean")
