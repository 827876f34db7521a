"""Filling containers of fixed capacity with items, as little space left as possible.

Minimum bin slack over the histogram of lengths: each container is opened with the largest length left, a bitset
subset-sum program finds the multiset of remaining lengths that comes closest to the capacity, and the same filling is
repeated as often as the counts allow.  The histogram has at most one entry per length, so the search runs on the
driver whatever the number of items; the items themselves are only ranked within their length and looked up.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from talewind.spool import Spool, partitions


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset within ``counts`` whose sum is closest to ``room`` from below, larger lengths first.

    One bit per reachable sum; a length that occurs c times is added in blocks of 1, 2, 4, ... copies.  The bitsets
    before each block are kept, and the counts are read off backwards.  The search ends as soon as ``room`` is reached.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left > 0:
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            block *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:  # this sum needs the block
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used, until every length is placed."""
    left = {x: n for x, n in counts.items() if n > 0}
    order = sorted(left)  # ascending; the largest remaining is at the end
    out = []
    while order:
        top = order[-1]
        if not left.get(top):
            order.pop()
            continue
        left[top] -= 1
        filling = best_filling(left, capacity - top)
        left[top] += 1
        filling[top] = filling.get(top, 0) + 1
        times = min(left[x] // n for x, n in filling.items())
        for x, n in filling.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((filling, times))
    return out


def pack(items: DataFrame, spool: Spool, capacity: int) -> DataFrame:
    """``(item_id, piece, size, container)`` for ``(item_id, size)``.

    An item larger than the capacity is cut into full pieces and a rest (piece 0, 1, ...); all others stay whole
    (piece 0).  Null and non-positive sizes take no space and get no row.  Equal ids are separate items.
    """
    spark = spool.spark
    big = F.floor((F.col("size") - 1) / capacity)  # full pieces besides the last
    cut = (
        items.select("item_id", F.col("size").cast("long").alias("size")).filter("size > 0")
        .select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), big), lambda i: F.least(F.lit(capacity).cast("long"), F.col("size") - i * capacity))).alias("piece", "size"))
    )
    order = ["size", "item_id", "piece"]
    cut = spool.cut(cut, "pieces")  # the range split reads its input twice: sizes are counted once
    ranked = spool.cut(cut.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "items")
    hist = {r["size"]: r["n"] for r in ranked.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most one row per length
    per_task = {r["part"]: r["n"] for r in ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    offsets, start = {}, 0
    for part in sorted(per_task):
        offsets[part] = start
        start += per_task[part]
    # in the order of sizes every length is one interval of ranks; a filling takes the next ranks of each of its lengths
    begin, start = {}, 0
    for size in sorted(hist):
        begin[size] = start
        start += hist[size]
    spans, base = [], 0
    for filling, times in plan(hist, capacity):
        for size, n in filling.items():
            spans.append((begin[size], n, base))
            begin[size] += n * times
        base += times
    spans.sort()
    lo, per, first = (np.array(x, np.int64) for x in zip(*spans)) if spans else (np.empty(0, np.int64),) * 3

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, frames):
            at = pdf["at"].to_numpy()
            rank = np.array([offsets[p] for p in (at >> 33)], np.int64) + (at & ((1 << 33) - 1))
            i = np.searchsorted(lo, rank, side="right") - 1
            yield pdf[["item_id", "piece", "size"]].assign(container=first[i] + (rank - lo[i]) // per[i])

    return ranked.mapInPandas(place, "item_id long, piece int, size long, container long")


def token_counts(documents: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """``documents`` with ``n_tokens``: length of the whole text in tokens of a byte-level BPE; null text has none.

    ``vocabulary`` is the path of a rank file (base64 token, rank) on the driver; it is sent to the executors once.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    keep = [c for c in documents.columns if c != text]
    schema = documents.select(*keep).schema.add("n_tokens", "long")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = None
        for pdf in filter(len, frames):
            enc = enc or load_encoding(SparkFiles.get(name))
            yield pdf[keep].assign(n_tokens=pd.array([None if t is None else len(enc.encode_ordinary(t)) for t in pdf[text]], "Int64"))

    return documents.mapInPandas(count, schema)


#: Fixed value: the pattern by which the public byte-level vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(vocabulary: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
