"""Connected components by a distributed union-find.

Every task builds a forest of its own edges; forests are merged level by level, each level in fewer tasks, so what
moves between levels is never more than one edge per vertex and task.  The last level runs in one task only while the
merged forest is within ``task_edges`` (16 bytes an edge); beyond that, rounds of large-star and small-star
contraction, which never put more than one vertex's distinct neighbours' minimum into a row, finish the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talewind.spool import Spool, partitions


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star forest of the edges: every vertex that is not its component's smallest, with that smallest vertex."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        # hook the larger root below the smaller one, then compress all paths
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, held = [], [], 0
    kept: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += len(batch)
        if held > 1_000_000:  # fold what was read so far into one forest, so that memory follows vertices, not edges
            kept = forest_of(np.concatenate(a), np.concatenate(b))
            a, b, held = [kept[0]], [kept[1]], 0
    if a:
        x, y = forest_of(np.concatenate(a), np.concatenate(b))
        for i in range(0, len(x), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000], pa.int64()), pa.array(y[i : i + 200_000], pa.int64())], ["a", "b"])


def _forest(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_local_forest, "a long, b long")


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; both keep components and bring vertices nearer to their smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return small.filter("a <> b").distinct()


def components(edges: DataFrame, spool: Spool, task_edges: int = 4_000_000) -> DataFrame:
    """``(v, root)`` for every vertex that is linked to a smaller one; ``root`` is its component's smallest vertex.

    ``edges`` has two int64 columns; rows with a null end or two equal ends link nothing, repeated edges are allowed.
    A vertex without a row is the smallest of its component.  No edges give no rows.
    """
    spark = spool.spark
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    forest = spool.cut(_forest(e), "forest")
    n = forest.count()
    while n > task_edges:
        nxt = spool.cut(_forest(_star_round(forest)), "forest")
        settled = forest.exceptAll(nxt).isEmpty() and nxt.count() == n
        spool.drop(forest)
        forest, n = nxt, nxt.count()
        if settled:  # a set of stars that no round changes: every vertex hangs below its smallest
            return forest.select(F.col("a").alias("v"), F.col("b").alias("root"))
    width = max(1, min(partitions(spark), n // 100_000))
    while width > 1:
        width = (width + 3) // 4
        forest = _forest(forest.coalesce(width) if width == 1 else forest.repartition(width, "b"))
    return spool.cut(_forest(forest.coalesce(1)), "components").select(F.col("a").alias("v"), F.col("b").alias("root"))
