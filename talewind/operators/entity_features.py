"""One wide row per entity from events, with a single shuffle.

Every task first folds its own rows into one counter per (entity, type); only those move, bucketed by entity and
sorted by (entity, type).  An entity arrives with at most one row per type and task, however many events it has.
Behind the shuffle the sorted runs are streamed into counters, totals and latest times, and an entity's row is emitted
from there as its run ends: no aggregate follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructType, TimestampType

from talewind.spool import partitions

#: Totals are kept in 76 digits on their way, so that only a final sum can be too large.
_SUM = pa.decimal256(76, 0)
_PARTIAL = "entity string, kind long, n long, latest long, total binary, over boolean"
_SCHEMA = pa.schema([("entity", pa.string()), ("kind", pa.int64()), ("n", pa.int64()), ("latest", pa.int64()), ("total", pa.binary()), ("over", pa.bool_())])
_LIMIT = 10**38
_FLUSH = 500_000


def _fold(t: pa.Table) -> pa.Table:
    """One row per (entity, kind), in the order in which they first occur."""
    g = t.group_by(["entity", "kind"], use_threads=False).aggregate([("n", "sum"), ("latest", "max"), ("total", "sum"), ("over", "max")])
    g = g.rename_columns(["entity", "kind", "n", "latest", "total", "over"])
    return g.set_column(4, "total", g["total"].cast(_SUM))


def _pack(t: pa.Table) -> list[pa.RecordBatch]:
    raw = pa.chunked_array([c.view(pa.binary(32)).cast(pa.binary()) for c in t["total"].chunks], pa.binary())
    return t.set_column(4, "total", raw).cast(_SCHEMA).to_batches(max_chunksize=50_000)


def _unpack(batch: pa.RecordBatch) -> pa.Table:
    t = pa.Table.from_batches([batch])
    return t.set_column(4, "total", pa.chunked_array([c.cast(pa.binary(32)).view(_SUM) for c in t["total"].chunks], _SUM))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        t = pa.Table.from_batches([batch]).rename_columns(["entity", "kind", "latest", "total", "over"])
        t = t.set_column(3, "total", t["total"].cast(_SUM)).add_column(2, "n", pa.array(np.ones(len(t), np.int64)))
        held.append(_fold(t))
        size += len(held[-1])
        if size > _FLUSH:
            held = [_fold(pa.concat_tables(held))]
            size = len(held[0])
            if size > _FLUSH:  # too many pairs to keep: hand them on, they meet again behind the shuffle
                yield from _pack(held[0])
                held, size = [], 0
    if held:
        yield from _pack(_fold(pa.concat_tables(held)))


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole entities, one row per (entity, kind), from rows sorted by both."""
    held: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        t = _unpack(batch)
        t = _fold(t if held is None else pa.concat_tables([held, t]))
        last = pc.index(t["entity"], t["entity"][-1]).as_py()
        if last:
            yield t.slice(0, last)
        held = t.slice(last).combine_chunks()
    if held is not None:
        yield held


def _values(t: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(n, latest, total) of rows; totals beyond 38 digits are null."""
    total = t["total"].combine_chunks()
    large = pc.or_(pc.fill_null(t["over"], False).combine_chunks(), pc.greater_equal(pc.abs(total), pa.scalar(_LIMIT, _SUM)))
    return t["n"].combine_chunks(), t["latest"].combine_chunks().cast(pa.timestamp("us", "UTC")), pc.if_else(large, pa.scalar(None, _SUM), total).cast(pa.decimal128(38, 0))


def _sorted_partials(events: DataFrame) -> DataFrame:
    amount = F.col("amount").try_cast("decimal(38,0)")
    rows = events.filter("entity is not null and kind is not null").select(
        "entity", F.col("kind").cast("long").alias("kind"), F.col("ts_us").cast("long").alias("latest"), F.coalesce(amount, F.lit(0).cast("decimal(38,0)")).alias("total"), (F.col("amount").isNotNull() & amount.isNull()).alias("over"))
    return rows.mapInArrow(_partial, _PARTIAL).repartition(partitions(events.sparkSession), "entity").sortWithinPartitions("entity", "kind")


def entity_features(events: DataFrame) -> DataFrame:
    """``(entity, features)`` from ``(entity, kind, ts_us, amount)``: ``features`` maps each kind to (n, latest, total).

    Rows with a null entity or kind are left out.  ``latest`` is null where all times are, ``total`` is 0 where no
    amount is given.  Amounts are whole numbers or their text; a total beyond 38 digits is null, and so is one with an
    amount beyond them or no number.  No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _entities(batches):
            n, latest, total = _values(t)
            start = np.flatnonzero(_starts(t))
            value = pa.StructArray.from_arrays([n, latest, total], ["n", "latest", "total"])
            maps = pa.MapArray.from_arrays(pa.array(np.append(start, len(t)), pa.int32()), t["kind"].combine_chunks(), value)
            yield from pa.table([t["entity"].take(pa.array(start)).combine_chunks(), maps], ["entity", "features"]).to_batches(max_chunksize=5_000)

    return _sorted_partials(events).mapInArrow(run, "entity string, features map<bigint, struct<n: bigint, latest: timestamp, total: decimal(38,0)>>")


def _starts(t: pa.Table) -> np.ndarray:
    """True at the first row of each entity."""
    e = t["entity"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.append(True, e[1:] != e[:-1])


def wide_features(events: DataFrame, kinds: list[int]) -> DataFrame:
    """The same as columns ``n_<kind>, latest_<kind>, total_<kind>`` of the given kinds, emitted from the stream itself.

    An entity without any of the kinds keeps its row; absent kinds have n and total 0 and a null latest.
    """
    schema = StructType().add("entity", StringType())
    for k in kinds:
        schema.add(f"n_{k}", LongType()).add(f"latest_{k}", TimestampType()).add(f"total_{k}", DecimalType(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _entities(batches):
            first = _starts(t)
            row, kind = np.cumsum(first) - 1, t["kind"].to_numpy()
            n, latest, total = _values(t)
            cols, zero = [t["entity"].take(pa.array(np.flatnonzero(first))).combine_chunks()], pa.scalar(0, pa.decimal128(38, 0))
            for k in kinds:
                at = np.flatnonzero(kind == k)
                where = np.full(row[-1] + 1, -1)
                where[row[at]] = at
                take, there = pa.array(np.maximum(where, 0), mask=where < 0), pa.array(where >= 0)
                cols += [pc.fill_null(n.take(take), 0), latest.take(take), pc.if_else(there, total.take(take), zero)]
            yield from pa.table(cols, schema.names).to_batches(max_chunksize=5_000)

    return _sorted_partials(events).mapInArrow(run, schema)


def wide(features: DataFrame, kinds: list[int]) -> DataFrame:
    """The map of :func:`entity_features` as the columns of :func:`wide_features`."""
    cols = []
    for k in kinds:
        f = F.col("features")[F.lit(k).cast("long")]
        cols += [F.coalesce(f["n"], F.lit(0)).alias(f"n_{k}"), f["latest"].alias(f"latest_{k}"), F.when(f.isNull(), F.lit(0)).otherwise(f["total"]).cast("decimal(38,0)").alias(f"total_{k}")]
    return features.select("entity", *cols)
