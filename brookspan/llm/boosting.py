"""Gradient-boosted trees for several classes over 0/1 features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Softmax boosting; each round has a tree of fixed depth per class.

    A tree of depth d is an array of 2^d - 1 feature numbers in heap order and
    2^d leaf values; a row goes right where the feature is set.
    """

    def __init__(self, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.3, least: int = 8, ridge: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.least, self.ridge = classes, rounds, depth, rate, least, ridge
        self.trees: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.start = np.zeros(classes)

    def fit(self, rows: np.ndarray, labels: np.ndarray) -> BoostedTrees:
        wanted = np.eye(self.classes)[labels]
        self.start = np.log(np.maximum(wanted.mean(axis=0), 1e-6))
        raw = np.tile(self.start, (len(rows), 1))
        columns = rows.astype(np.float32)
        for _ in range(self.rounds):
            odds = softmax(raw)
            group = []
            for c in range(self.classes):
                features, values, leaf = self._tree(columns, odds[:, c] - wanted[:, c], odds[:, c] * (1 - odds[:, c]))
                group.append((features, values))
                raw[:, c] += values[leaf]
            self.trees.append(group)
        return self

    def _tree(self, rows: np.ndarray, slope: np.ndarray, curve: np.ndarray):
        node = np.zeros(len(rows), np.int64)
        features = np.zeros(2**self.depth - 1, np.int64)
        score = lambda g, h: g * g / (h + self.ridge)
        pair = np.column_stack([slope, curve, np.ones(len(rows))]).astype(np.float32)
        for level in range(self.depth):
            first = 2**level - 1
            for at in range(first, 2 * first + 1):
                own = np.flatnonzero(node == at)
                if len(own) >= 2 * self.least:
                    right = rows[own].T @ pair[own]
                    whole = pair[own].sum(axis=0)
                    left = whole - right
                    gain = score(right[:, 0], right[:, 1]) + score(left[:, 0], left[:, 1]) - score(whole[0], whole[1])
                    gain[(right[:, 2] < self.least) | (left[:, 2] < self.least)] = -1
                    features[at] = int(gain.argmax())
                node[own] = 2 * at + 1 + (rows[own, features[at]] > 0)
        leaf = node - (2**self.depth - 1)
        g = np.bincount(leaf, slope, 2**self.depth)
        h = np.bincount(leaf, curve, 2**self.depth)
        return features, -self.rate * g / (h + self.ridge), leaf

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Logarithms of the classes' probabilities."""
        raw = np.tile(self.start, (len(rows), 1))
        set_ = rows > 0
        every = np.arange(len(rows))
        for group in self.trees:
            for c, (features, values) in enumerate(group):
                node = np.zeros(len(rows), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + set_[every, features[node]]
                raw[:, c] += values[node - (2**self.depth - 1)]
        return np.log(np.maximum(softmax(raw), 1e-9))


def softmax(raw: np.ndarray) -> np.ndarray:
    raw = np.exp(raw - raw.max(axis=1, keepdims=True))
    return raw / raw.sum(axis=1, keepdims=True)
