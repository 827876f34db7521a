"""Parent-child rows to full hierarchies.

Leaves are peeled until only loops are left; loops are cut; the forest is walked as one Euler tour per tree, whose
linked list is ranked in parallel (contraction inside blocks, then pointer doubling over the links between blocks).
Entry and exit positions give depth, descendants and, in one ordered pass over the tours, every path.  Groups all of
whose trees lie inside them go through the same steps in one task each, while they are small; larger ones, and rows
without groups, go through them distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from talewind.spool import Spool, partitions

#: Marks of a list's end: below a true root, and below a node at which a loop was cut.
END, CUT = -1, -2


def peel(k: np.ndarray, p: np.ndarray, children: np.ndarray) -> np.ndarray:
    """True where a node stays after leaves have been removed again and again.

    ``children`` counts all children, also those outside these rows, so a node with an unseen child stays.
    """
    order = np.argsort(k, kind="stable")
    at = np.searchsorted(k, p, sorter=order)
    at = np.where(at < len(k), at, 0)
    parent = np.where((p >= 0) & (k[order[at]] == p), order[at], -1) if len(k) else np.empty(0, np.int64)
    left, stays = children.copy(), np.ones(len(k), bool)
    now = np.flatnonzero(left == 0)
    while len(now):
        stays[now] = False
        up = parent[now]
        up = up[up >= 0]
        np.subtract.at(left, up, 1)
        up = np.unique(up)
        now = up[(left[up] == 0) & stays[up]]
    return stays


def contract(elem: np.ndarray, succ: np.ndarray, hops: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Follow links inside these rows: the first element outside (or END, CUT), hops until there, last element passed."""
    order = np.argsort(elem, kind="stable")
    n = len(elem)
    at = np.searchsorted(elem, succ, sorter=order)
    at = np.where(at < n, at, 0)
    nxt = np.where((succ >= 0) & (elem[order[at]] == succ), order[at], n) if n else np.empty(0, np.int64)
    nxt = np.append(nxt, n)
    hops, last, end = (np.append(x, y) for x, y in ((hops, 0), (last, -1), (succ, -1)))
    for _ in range(int(n).bit_length() + 1):
        inner = nxt != n
        inner[n] = False
        if not inner.any():
            break
        to = nxt[inner]
        hops[inner] += hops[to]
        last[inner], end[inner] = last[to], end[to]
        nxt[inner] = nxt[to]
    return end[:n], hops[:n], last[:n]


def _contract_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    end, hops, last = contract(*(pdf[c].to_numpy(np.int64) for c in ("elem", "succ", "hops", "last")))
    return pd.DataFrame({"elem": pdf["elem"].to_numpy(), "succ": end, "hops": hops, "last": last})


_LINK = "elem long, succ long, hops long, last long"


def rank_lists(links: DataFrame, spool: Spool, task_rows: int) -> DataFrame:
    """Ranks of linked lists given as ``(block, elem, succ)``, ``succ`` END or CUT at a list's last element.

    Gives ``(elem, succ, hops, last)``: the list's end mark, the elements from here to the end (this one included), and
    the list's last element.  Blocks hold at most about ``task_rows`` rows.
    """
    local = spool.cut(
        links.select("block", "elem", "succ", F.lit(1).cast("long").alias("hops"), F.col("elem").alias("last"))
        .groupBy("block").applyInPandas(_contract_frame, _LINK), "local-ranks")
    heads = local.filter("succ >= 0").select(F.col("succ").alias("elem")).distinct()
    if heads.isEmpty():
        return local
    reduced = spool.cut(local.join(heads, "elem", "left_semi"), "heads")
    n = reduced.count()
    if n <= task_rows:
        whole = reduced.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(_contract_frame, _LINK)
    else:
        for _ in range(n.bit_length() + 1):  # pointer doubling: every round doubles the distance covered
            to = reduced.select(*(F.col(c).alias(f"{c}_") for c in reduced.columns))
            new = spool.cut(
                reduced.join(to, F.col("succ") == F.col("elem_"), "left").select(
                    "elem", F.coalesce("succ_", "succ").alias("succ"), (F.col("hops") + F.coalesce("hops_", F.lit(0))).alias("hops"),
                    F.coalesce("last_", "last").alias("last")), "doubling")
            spool.drop(reduced)
            reduced = new
            if reduced.filter("succ >= 0").isEmpty():
                break
        whole = reduced
    to = whole.select(*(F.col(c).alias(f"{c}_") for c in ("elem", "succ", "hops", "last")))
    return local.join(to, F.col("succ") == F.col("elem_"), "left").select(
        "elem", F.coalesce("succ_", "succ").alias("succ"), (F.col("hops") + F.coalesce("hops_", F.lit(0))).alias("hops"),
        F.coalesce("last_", "last").alias("last"))


def loop_nodes(nodes: DataFrame, spool: Spool, task_rows: int) -> DataFrame:
    """Keys of the nodes that lie on a loop, from ``(block, k, p, children)``, by peeling leaves."""

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        k, p = pdf["k"].to_numpy(np.int64), pdf["p"].to_numpy(np.int64)
        return pdf.loc[peel(k, p, pdf["children"].to_numpy(np.int64)), ["k", "p"]]

    left = spool.cut(nodes.groupBy("block").applyInPandas(rest, "k long, p long"), "unpeeled")
    n = left.count()
    if n <= task_rows:
        def last(pdf: pd.DataFrame) -> pd.DataFrame:
            k, p = pdf["k"].to_numpy(np.int64), pdf["p"].to_numpy(np.int64)
            count = pd.Series(p).value_counts()
            return pdf.loc[peel(k, p, count.reindex(k, fill_value=0).to_numpy(np.int64)), ["k"]]
        return left.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(last, "k long")
    jump = left.filter("p >= 0")
    for _ in range(n.bit_length()):  # after as many steps as there are nodes, whoever still has an ancestor stands on a loop
        to = jump.select(F.col("k").alias("k_"), F.col("p").alias("p_"))
        jump = spool.cut(jump.join(to, F.col("p") == F.col("k_")).select("k", F.col("p_").alias("p")), "jump")
    return jump.select(F.col("p").alias("k")).distinct()


def with_sibling(children: DataFrame, spool: Spool) -> DataFrame:
    """``(p, k, nxt, first)``: each child with its next sibling by key (null at the last) and whether it is the first.

    The rows are split by ranges of (p, k), so the children of one parent may lie in many tasks; one row per task
    mends the seams.
    """
    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            nxt_p = pdf["p"].shift(-1)
            out = pdf.assign(nxt=pdf["k"].shift(-1).where(nxt_p == pdf["p"]).astype("Int64"), edge=False)
            held = pdf.iloc[-1:]
            yield out.iloc[:-1]
        if held is not None:
            yield held.assign(nxt=pd.array([None], "Int64"), edge=True)

    got = spool.cut(
        children.select("p", "k").repartitionByRange(partitions(spool.spark), "p", "k").sortWithinPartitions("p", "k")
        .withColumn("part", F.spark_partition_id()).mapInPandas(pairs, "p long, k long, part int, nxt long, edge boolean"), "siblings")
    seams = got.groupBy("part").agg(F.min_by(F.struct("p", "k"), F.struct("p", "k")).alias("lo"), F.max_by(F.struct("p", "k"), F.struct("p", "k")).alias("hi")).orderBy("part").collect()
    over = [(a.hi.k, b.lo.k) for a, b in zip(seams, seams[1:]) if a.hi.p == b.lo.p]  # one pair per task at most
    mend = spool.spark.createDataFrame(over, "k long, over long")
    whole = got.join(F.broadcast(mend), "k", "left").select("p", "k", F.coalesce("nxt", "over").alias("nxt"))
    return whole


def tour_links(nodes: DataFrame, spool: Spool) -> DataFrame:
    """Successor links of the Euler tours of ``(block, k, p, cut)``: element 2k enters node k, 2k+1 leaves it."""
    kids = nodes.filter("p >= 0").select("p", "k")
    sib = with_sibling(kids, spool)
    first = kids.groupBy("p").agg(F.min("k").alias("first")).select(F.col("p").alias("k"), "first")
    n = nodes.join(sib.select("k", "nxt"), "k", "left").join(first, "k", "left")
    enter = n.select("block", (F.col("k") * 2).alias("elem"), F.coalesce(F.col("first") * 2, F.col("k") * 2 + 1).alias("succ"))
    leave = n.select(
        "block", (F.col("k") * 2 + 1).alias("elem"),
        F.coalesce(F.col("nxt") * 2, F.when(F.col("p") >= 0, F.col("p") * 2 + 1), F.when(F.col("cut"), F.lit(CUT)).otherwise(F.lit(END)).cast("long")).alias("succ"))
    return enter.unionByName(leave)


_NODE = "k long, root long, h_in long, h_out long, cycle boolean"
_OUT = "k long, path string, depth int, root long, descendants long, enter long, leave long"


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of :func:`hierarchy` from nodes in the order of their tours; nodes that are only ``open`` give none."""
    tour, stack = None, []  # (leave position, path)
    for pdf in frames:
        out = []
        for k, root, h_in, h_out, cycle, open_ in zip(*(pdf[c].tolist() for c in ("k", "root", "h_in", "h_out", "cycle", "open"))):
            if root != tour:
                tour, stack = root, []
            while stack and stack[-1][0] > h_in:
                stack.pop()
            path = "cycle" if cycle else f"{stack[-1][1]}/{k}" if stack else str(k)
            if not open_:
                out.append((k, path, None, None, None, None, None) if cycle else (k, path, len(stack), root, (h_in - h_out) // 2, -h_in, -h_out))
            if not cycle:
                stack.append((h_out, path))
        got = pd.DataFrame(out, columns=["k", "path", "depth", "root", "descendants", "enter", "leave"])
        yield got.astype(dict.fromkeys(("depth", "root", "descendants", "enter", "leave"), "Int64"))


def local_tours(k: np.ndarray, p: np.ndarray) -> pd.DataFrame:
    """Nodes in the order of their tours, of rows that hold all of their trees; ``p`` -1 or unknown makes a root."""
    order = np.argsort(k, kind="stable")
    at = np.minimum(np.searchsorted(k, p, sorter=order), max(0, len(k) - 1))
    up = np.where((p >= 0) & (k[order[at]] == p), order[at], -1) if len(k) else np.empty(0, np.int64)  # place of the parent
    children = np.bincount(up[up >= 0], minlength=len(k)).astype(np.int64)
    cut = peel(k, np.where(up >= 0, p, -1), children)
    up = np.where(cut, -1, up)
    # element 2i enters the node at place i, 2i + 1 leaves it
    kids = np.flatnonzero(up >= 0)
    kids = kids[np.lexsort((k[kids], up[kids]))]
    enter, leave = 2 * np.arange(len(k)) + 1, np.full(len(k), END)
    same = up[kids[1:]] == up[kids[:-1]]
    leave[kids] = 2 * up[kids] + 1
    leave[kids[:-1][same]] = 2 * kids[1:][same]
    first = kids[np.append(True, ~same)] if len(kids) else kids
    enter[up[first]] = 2 * first
    elem = np.arange(2 * len(k))
    succ = np.empty(2 * len(k), np.int64)
    succ[0::2], succ[1::2] = enter, leave
    _, hops, last = contract(elem, succ, np.ones(2 * len(k), np.int64), elem.copy())
    root = last[0::2] // 2
    nodes = pd.DataFrame({"k": k, "root": k[root], "h_in": hops[0::2], "h_out": hops[1::2], "cycle": cut[root], "open": False})
    return nodes.iloc[np.lexsort((-nodes["h_in"].to_numpy(), nodes["root"].to_numpy()))]


def distributed_hierarchy(raw: DataFrame, spool: Spool, block: Column, task_rows: int) -> DataFrame:
    """:func:`hierarchy` of ``(k, p, grp)`` rows whose trees may lie anywhere; ``block`` says which rows meet in a task first."""
    spark, mark = spool.spark, spool.mark()
    known = raw.select(F.col("k").alias("p"), F.lit(True).alias("known"))
    asked = raw.withColumn("p", F.when(F.col("p") >= 0, F.col("p")).otherwise(-1 - F.col("k")))  # rows without a parent have no key in common
    base = asked.join(known, "p", "left").select("k", F.when(F.col("known"), F.col("p")).otherwise(F.lit(-1)).cast("long").alias("p"), "grp")
    counts = base.filter("p >= 0").groupBy("p").agg(F.count("*").alias("children")).select(F.col("p").alias("k"), "children")
    nodes = spool.cut(base.join(counts, "k", "left").select(block.alias("block"), "k", "p", F.coalesce("children", F.lit(0)).cast("long").alias("children")), "nodes")
    loops = spool.cut(loop_nodes(nodes, spool, task_rows).withColumn("cut", F.lit(True)), "loops")
    trees = nodes.join(loops, "k", "left").select("block", "k", F.when(F.col("cut"), F.lit(-1)).otherwise(F.col("p")).cast("long").alias("p"), F.coalesce("cut", F.lit(False)).alias("cut"))
    ranks = rank_lists(tour_links(spool.cut(trees, "trees"), spool), spool, task_rows)
    # hops counts down to the tree's end, so ascending order of -hops is the tour
    both = ranks.groupBy(F.expr("elem div 2").alias("k")).agg(F.max("last").alias("last"), F.max("hops").alias("h_in"), F.min("hops").alias("h_out"), F.max("succ").alias("succ"))
    order = [F.col("root"), F.col("h_in").desc()]
    ranked = spool.cut(both.select("k", F.expr("last div 2").alias("root"), "h_in", "h_out", (F.col("succ") == CUT).alias("cycle")), "ranked")
    n_parts = partitions(spark)
    tour = spool.cut(ranked.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "tour")
    spool.drop_since(mark, tour)
    begin = tour.groupBy("part").agg(F.min(F.struct("root", (-F.col("h_in")).alias("at"))).alias("b")).orderBy("part").collect()  # a row per task
    parts, roots, ats = (np.array(x, np.int64) for x in zip(*((r.part, r.b.root, r.b["at"]) for r in begin))) if begin else (np.empty(0, np.int64),) * 3

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for every part that begins inside a node of an earlier one."""
        for pdf in filter(len, frames):
            i = np.searchsorted(parts, pdf["part"].to_numpy())
            root, out = pdf["root"].to_numpy(), -pdf["h_out"].to_numpy()
            reach = np.ones(len(pdf), bool)
            j = i + 1
            while (reach := reach & (j < len(parts))).any():
                x = np.minimum(j, len(parts) - 1)
                reach &= (roots[x] == root) & (ats[x] < out)
                if reach.any():
                    yield pdf[reach].assign(part=parts[x[reach]], open=True)
                j = j + 1

    more = tour.mapInPandas(opened, f"{_NODE}, part int, open boolean")
    every = tour.withColumn("open", F.lit(False)).unionByName(more)
    return every.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", *order).mapInPandas(_walk, _OUT)


def hierarchy(links: DataFrame, spool: Spool, block_by: str | None = None, task_rows: int = 1_000_000) -> DataFrame:
    """Full hierarchy of ``(k, p)`` rows: ``(k, path, depth, root, descendants, enter, leave)``.

    ``k`` is a unique non-negative int64 key, ``p`` the parent's key.  A null, negative or unknown parent makes a root.
    Nodes on a loop or below one have ``path`` = 'cycle' and null in all other columns but ``k``.  ``enter`` and
    ``leave`` are positions in the root's Euler tour: v lies below u exactly if they share the root and
    u.enter < v.enter < u.leave, so descendants are an interval.  ``block_by`` names a column all of whose trees stay
    within one value; groups of more than ``task_rows`` / 4 rows, and all rows without ``block_by``, are split by key.
    An empty table gives no rows.
    """
    spark = spool.spark
    cols = [F.col("k").cast("long").alias("k"), F.col("p").cast("long").alias("p"), (F.col(block_by) if block_by else F.lit(None)).cast("string").alias("grp")]
    raw = spool.cut(links.select(*cols).filter("k is not null"), "links")
    sizes = raw.groupBy("grp").count()
    n = raw.count()
    blocks = max(partitions(spark), -(-n * 4 // task_rows))
    big = [r.grp for r in sizes.filter((F.col("count") > task_rows // 4) | F.col("grp").isNull()).collect()]  # at most 4 n / task_rows, and the null one
    split = F.col("grp").isNull() | F.col("grp").isin([g for g in big if g is not None])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return local_tours(pdf["k"].to_numpy(np.int64), pdf["p"].fillna(-1).to_numpy(np.int64))

    out = raw.filter(~split).withColumn("block", F.pmod(F.xxhash64("grp"), F.lit(blocks))).groupBy("block").applyInPandas(whole, f"{_NODE}, open boolean").mapInPandas(_walk, _OUT)
    if big:
        out = out.unionByName(distributed_hierarchy(raw.filter(split), spool, F.pmod(F.xxhash64("k"), F.lit(blocks)), task_rows))
    return out
