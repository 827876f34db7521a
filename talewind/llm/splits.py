"""Train, validation and test splits that keep related records together.

Records that name a common entity, directly or through others, form groups by a distributed union-find over the
names; groups are then assigned largest first, each to the split that is furthest below its target.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from talewind.operators.components import components
from talewind.spool import Spool, partitions, small


def related_groups(records: DataFrame, spool: Spool, names: list[str]) -> DataFrame:
    """``(row_id, group_id)``: ``group_id`` is the smallest row_id among all records tied to this one (itself if alone).

    ``records`` has a unique non-negative ``row_id`` and string columns ``names`` of one name space; null names tie
    nothing.  The union-find runs over names, not records: a name's number is that of its first place of occurrence, so
    however many records share a name, it is one vertex, and only distinct pairs of names named together are edges.
    """
    width = len(names)
    held = spool.cut(records.select("row_id", *names), "records")
    at = F.array(*(F.struct(F.col(c).alias("name"), (F.col("row_id") * width + i).alias("id")) for i, c in enumerate(names)))
    ids = spool.cut(held.select(F.explode(at).alias("x")).select("x.*").filter("name is not null").groupBy("name").agg(F.min("id").alias("id")), "names")
    edges = None
    for c in names[1:]:
        pair = held.select(F.col(names[0]).alias("n0"), F.col(c).alias("n1")).filter("n0 is not null and n1 is not null and n0 <> n1").distinct()
        pair = pair.join(ids.select(F.col("name").alias("n0"), F.col("id").alias("a")), "n0").join(ids.select(F.col("name").alias("n1"), F.col("id").alias("b")), "n1").select("a", "b")
        edges = pair if edges is None else edges.unionByName(pair)
    if edges is None:
        edges = spool.spark.createDataFrame([], "a long, b long")
    if width > 2:  # a record without its first name still ties the others
        for i in range(1, width):
            for j in range(i + 1, width):
                pair = held.select(F.col(names[i]).alias("n0"), F.col(names[j]).alias("n1")).filter("n0 is not null and n1 is not null and n0 <> n1").distinct()
                edges = edges.unionByName(pair.join(ids.select(F.col("name").alias("n0"), F.col("id").alias("a")), "n0").join(ids.select(F.col("name").alias("n1"), F.col("id").alias("b")), "n1").select("a", "b"))
    roots = components(edges, spool).select(F.col("v").alias("id"), "root")
    of_name = spool.cut(ids.join(roots, "id", "left").select(F.col("name"), F.floor(F.coalesce("root", "id") / width).alias("g")), "groups")
    named = held.select("row_id", F.coalesce(*(F.col(c) for c in names)).alias("name"))
    # records without a name meet nothing; a name of very many records meets its group in a broadcast, or in a join whose large partitions are split at run time
    found = named.filter("name is not null").join(small(of_name), "name").select("row_id", F.col("g").alias("group_id"))
    return found.unionByName(named.filter("name is null").select("row_id", F.col("row_id").alias("group_id")))


def assign(sizes: list[tuple[int, int]], shares: tuple[float, ...]) -> list[list[int]]:
    """How many groups of each size go to each split: ``sizes`` holds (size, number of groups), largest first.

    The same as taking the groups one by one, largest first, each to the split furthest below its target (ties to the
    earlier split), but a run of equal groups is settled at once: its groups take the highest steps of the falling
    deficits, found by bisection over the deficit at which the run ends.
    """
    total = sum(s * n for s, n in sizes)
    lack = np.array([total * x for x in shares], float)
    out = []
    for size, n in sizes:
        # deficits before the j-th group of this size are lack[i] - j * size; the n largest of them are taken
        lo, hi = float(lack.min() - size * (n + 1)), float(lack.max() + size)
        for _ in range(200):
            mid = (lo + hi) / 2
            if np.maximum(0, np.ceil((lack - mid) / size)).sum() > n:
                lo = mid
            else:
                hi = mid
            if hi - lo < 1e-9 * max(1.0, abs(hi)):
                break
        took = np.maximum(0, np.ceil((lack - hi) / size)).astype(int)
        for _ in range(n - int(took.sum())):  # at most one step per split is left at the border
            took[int(np.argmax(lack - took * size))] += 1
        lack -= took * size
        out.append(took.tolist())
    return out


def split_groups(groups: DataFrame, spool: Spool, shares: dict[str, float]) -> DataFrame:
    """``(row_id, group_id, split)`` of ``(row_id, group_id)``: whole groups only, sizes as near to the shares as the greedy rule gives.

    What reaches the driver is the histogram of group sizes (at most about the square root of twice the number of
    records) and one count per task.  Groups of one size are numbered by group_id.
    """
    spark = spool.spark
    sized = spool.cut(groups.groupBy("group_id").agg(F.count("*").alias("size")), "sizes")
    order = [F.col("size").desc(), F.col("group_id")]
    ranked = spool.cut(sized.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    hist = [(r["size"], r["n"]) for r in sized.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()]
    if not hist:
        return groups.withColumn("split", F.lit(None).cast("string"))
    per_task = ranked.groupBy((F.shiftright("at", 33)).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    start, offsets = 0, []
    for r in per_task:
        offsets.append((r["part"], start))
        start += r["n"]
    off = spark.createDataFrame(offsets, "part long, off long")
    rows, start = [], 0
    for (size, n), took in zip(hist, assign(hist, tuple(shares.values()))):
        at = start
        for name, k in zip(shares, took):
            if k:
                rows.append((size, at, at + k, name))
            at += k
        start += n
    plan = spark.createDataFrame(rows, "size long, lo long, hi long, split string")
    placed = (
        ranked.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(off), "part").withColumn("pos", F.col("off") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
        .join(plan, "size").filter("pos >= lo and pos < hi").select("group_id", "split")
    )
    return groups.join(placed, "group_id").select("row_id", "group_id", "split")
