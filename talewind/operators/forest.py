"""Random forests grown level by level on binned columns, trees spread over tasks.

The training rows are a bounded sample that every task holds in one byte a value; what comes back are the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

BINS = 64


@dataclass
class Tree:
    """Nodes in breadth-first order: ``x[feature] <= cut`` goes to ``left``, else to ``left + 1``; ``left`` -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    share: np.ndarray  # class shares of every node

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return at
            n = at[inner]
            at[inner] = self.left[n] + (x[inner, self.feature[n]] > self.cut[n])


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """Cuts between the bins of each column: quantiles of its distinct values."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        mid = (v[1:] + v[:-1]) / 2
        out.append(mid if len(mid) < BINS else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def grow(b: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, edges: list[np.ndarray], depth: int, rng: np.random.Generator) -> Tree:
    """One tree on a bootstrap sample; at each node the square root of all columns is tried, by weighted Gini impurity."""
    n, d = b.shape
    pick = rng.integers(0, n, n)
    b, y, w = b[pick], y[pick], w[pick]
    tried = max(1, int(np.sqrt(d)))
    node, level = np.zeros(n, np.int64), 1  # node of each row within the level
    feature, cut, left, share = [], [], [], []
    made = 1
    for at_depth in range(depth + 1):
        total = np.bincount(node * classes + y, w, level * classes).reshape(level, classes)
        weight = total.sum(1)
        share.append(total / np.maximum(weight, 1e-300)[:, None])
        f = np.full(level, -1)
        c, child = np.zeros(level), np.full(level, -1)
        split = np.full(level, -1)  # bin
        if at_depth < depth and d:
            cols = np.argsort(rng.random((level, d)), axis=1)[:, :tried] if d > tried else np.tile(np.arange(d), (level, 1))
            best = np.full(level, 1e-12)
            before = (total**2).sum(1) / np.maximum(weight, 1e-300)
            for s in range(cols.shape[1]):
                col = cols[:, s]
                key = (node * BINS + b[np.arange(n), col[node]]) * classes + y
                h = np.bincount(key, w, level * BINS * classes).reshape(level, BINS, classes).cumsum(1)
                lo, hi = h[:, :-1], total[:, None] - h[:, :-1]
                nl, nr = lo.sum(2), hi.sum(2)
                gain = (lo**2).sum(2) / np.maximum(nl, 1e-300) + (hi**2).sum(2) / np.maximum(nr, 1e-300) - before[:, None]
                gain = np.where((nl > 1e-12) & (nr > 1e-12), gain, -1)
                g = gain.argmax(1)
                better = gain[np.arange(level), g] > best
                best[better] = gain[np.arange(level), g][better]
                f[better], split[better] = col[better], g[better]
            inner = np.flatnonzero(f >= 0)
            child[inner] = made + 2 * np.arange(len(inner))
            c[inner] = [edges[f[i]][min(split[i], len(edges[f[i]]) - 1)] for i in inner]
        feature.append(np.maximum(f, 0))
        cut.append(c)
        left.append(child)
        go = child[node] >= 0
        if not go.any():
            break
        nxt = np.cumsum(child >= 0) - 1
        b, y, w, old = b[go], y[go], w[go], node[go]
        n = len(y)
        node = 2 * nxt[old] + (b[np.arange(n), f[old]] > split[old])
        level = 2 * int((child >= 0).sum())
        made += level
    return Tree(np.concatenate(feature).astype(np.int32), np.concatenate(cut), np.concatenate(left).astype(np.int32), np.concatenate(share).astype(np.float32))


@dataclass
class Forest:
    trees: list[Tree]
    classes: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))
        for t in self.trees:
            out += t.share[t.leaves(x)]
        return out / max(1, len(self.trees))


def balanced(y: np.ndarray, classes: int) -> np.ndarray:
    """Weights under which every class that occurs counts the same."""
    n = np.bincount(y, minlength=classes)
    return len(y) / (max(1, (n > 0).sum()) * np.maximum(n, 1))[y]


def fit_forests(spark: SparkSession, x: np.ndarray, y: np.ndarray, classes: int, parts: list[np.ndarray], trees: int, depth: int, seed: int) -> list[Forest]:
    """One forest per index array of ``parts`` (its training rows), all grown in one job, trees spread over tasks."""
    import pickle

    edges = [edges_of(x[p]) for p in parts]
    bins = [binned(x[p], e) for p, e in zip(parts, edges)]
    labels = [y[p] for p in parts]
    held = spark.sparkContext.broadcast((bins, labels, edges))  # a byte a value of the bounded sample
    chunk = max(1, -(-trees * len(parts) // (4 * spark.sparkContext.defaultParallelism)))
    jobs = [(i, s, min(s + chunk, trees)) for i in range(len(parts)) for s in range(0, trees, chunk)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, labels, edges = held.value
        for pdf in frames:
            for i, a, b in zip(pdf["i"], pdf["a"], pdf["b"]):
                w = balanced(labels[i], classes)
                got = [grow(bins[i], labels[i], w, classes, edges[i], depth, np.random.default_rng([seed, i, t])) for t in range(a, b)]
                yield pd.DataFrame({"i": [i], "a": [a], "trees": [pickle.dumps(got)]})

    rows = spark.createDataFrame(jobs, "i int, a int, b int").repartition(len(jobs)).mapInPandas(run, "i int, a int, trees binary").collect()
    held.unpersist()
    out: list[list[Tree]] = [[] for _ in parts]
    for r in sorted(rows, key=lambda r: (r.i, r.a)):
        out[r.i] += pickle.loads(bytes(r.trees))
    return [Forest(t, classes) for t in out]
