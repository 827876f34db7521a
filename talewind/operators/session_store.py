"""Sessions kept in a table that grows batch by batch.

A batch's rows are first folded into cells no longer than the gap, which combine before any shuffle, so that a key
with a large share of all rows shrinks inside its tasks; cells make local sessions inside (key, time bucket), and only
local sessions move on.  They are compared with the stored sessions of the time slots they can touch; whatever lies
within the gap is bridged into one session, and only the touched slots are replaced.  A commit is one rename of a
manifest that names every slot's current files and the batches taken in: readers see the table before or after a
batch, never between, an uncommitted batch leaves no trace but unused files, and a replayed one changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from talewind.spool import Home, Spool

SESSION = "key string, start_us long, end_us long, min_seq long, max_seq long, n_events long"


def local_sessions(rows: DataFrame, keys: list[str], gap_s: int, bucket_s: int = 21_600) -> DataFrame:
    """Sessions inside one (keys, time bucket) of ``(*keys, ts_us, seq)``; a pause of more than ``gap_s`` splits, equal doesn't.

    Null keys group with null keys; rows with a null ``ts_us`` must have been left out.  Equal times never split.  Two
    rows of one cell (a piece of the bucket as long as the gap) are never more than the gap apart.
    """
    gap, bucket = max(1, gap_s * 1_000_000), bucket_s * 1_000_000
    at = F.floor(F.col("ts_us") / F.lit(bucket))
    cells = (
        rows.groupBy(*keys, at.alias("bucket"), F.expr(f"(ts_us - floor(ts_us / {bucket}) * {bucket}) div {gap}").alias("cell"))
        .agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("n_events"))
    )
    w = Window.partitionBy(*keys, "bucket").orderBy("cell")
    cut = (F.col("start_us") - F.lag("end_us").over(w) > gap_s * 1_000_000).cast("int")
    return (
        cells.withColumn("cut", cut).withColumn("part", F.sum(F.coalesce("cut", F.lit(0))).over(w))
        .groupBy(*keys, "bucket", "part")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"), F.sum("n_events").alias("n_events"))
        .drop("bucket", "part")
    )


def bridge(sessions: DataFrame, gap_s: int, *extra: Column) -> DataFrame:
    """Merge session rows of one key that lie within the gap of each other, however many they chain.

    The rows of a key are intervals more than the gap apart within each bucket or store, so their number is bounded by
    the time they span, not by the events behind them.
    """
    w = Window.partitionBy("key").orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        sessions.withColumn("cut", F.coalesce((F.col("start_us") - reach > gap_s * 1_000_000).cast("int"), F.lit(0)))
        .withColumn("part", F.sum("cut").over(w)).groupBy("key", "part")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"), F.sum("n_events").alias("n_events"), *extra)
        .drop("part")
    )


class Taken:
    """Batch numbers taken in, as disjoint ranges, so that any number of successive batches stays one entry."""

    def __init__(self, ranges: list[list[int]] | None = None):
        self.ranges = [list(r) for r in ranges or []]

    def __contains__(self, batch: int) -> bool:
        return any(lo <= batch <= hi for lo, hi in self.ranges)

    def and_(self, batch: int | None) -> Taken:
        out: list[list[int]] = []
        for lo, hi in sorted(self.ranges + ([] if batch is None else [[batch, batch]])):
            if out and lo <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return Taken(out)


class Versions:
    """Numbered manifests below a folder; what the last one names is the table."""

    def __init__(self, home: Home):
        self.home, self.version, self.taken, self.state = home, 0, Taken(), {}
        done = [x for x in home.names() if x.startswith("manifest-")]
        if done:
            kept = json.loads(home.read_text(done[-1]))
            self.version, self.taken, self.state = kept["version"], Taken(kept["taken"]), kept["state"]

    def folder(self, what: str) -> str:
        """A name no other attempt uses, so that what a lost attempt wrote is never read nor in the way."""
        return f"{what}-{self.version + 1:09d}-{uuid.uuid4().hex[:8]}"

    def commit(self, state: dict, batch: int | None) -> None:
        taken = self.taken.and_(batch)
        self.home.commit_text(f"manifest-{self.version + 1:09d}.json", json.dumps({"version": self.version + 1, "taken": taken.ranges, "state": state}))
        self.version, self.taken, self.state = self.version + 1, taken, state

    def vacuum(self) -> None:
        """Delete earlier manifests and all folders the last one does not name; no reader or writer may be at work."""
        used = {x.split("/")[0] for x in _texts(self.state)}
        for name in self.home.names():
            if name != f"manifest-{self.version:09d}.json" and name not in used:
                self.home.remove(name)


def _texts(x) -> list[str]:
    if isinstance(x, dict):
        return [t for v in x.values() for t in _texts(v)]
    if isinstance(x, list):
        return [t for v in x for t in _texts(v)]
    return [x] if isinstance(x, str) else []


class SessionStore:
    """The stored table below ``home``: parquet per time slot and version, and a numbered manifest."""

    def __init__(self, home: Home, gap_s: int = 300, slot_s: int = 7 * 86_400):
        self.home, self.gap_s, self.slot_us = home, gap_s, slot_s * 1_000_000
        self.versions = Versions(home)

    @property
    def version(self) -> int:
        return self.versions.version

    @property
    def slots(self) -> dict[int, dict]:
        return {int(k): v for k, v in self.versions.state.items()}

    def read(self, slots: list[int] | None = None) -> DataFrame:
        """The current sessions, of all slots or the given ones."""
        paths = [self.home.path(v["path"]) for k, v in self.slots.items() if slots is None or k in slots]
        spark = self.home.spark
        return spark.read.schema(SESSION).parquet(*paths) if paths else spark.createDataFrame([], SESSION)

    def ingest(self, batch: DataFrame, batch_id: int | None = None) -> bool:
        """Take in a batch's local sessions ``(key, start_us, end_us, min_seq, max_seq, n_events)``; rows may overlap.

        A batch number that was taken in before is left out, and the result is false.  Without a number nothing tells
        a replay from new rows.
        """
        if batch_id is not None and batch_id in self.versions.taken:
            return False
        home, gap, scratch = self.home, self.gap_s * 1_000_000, Spool(self.home.spark, "ingest")
        new = scratch.cut(batch, "local")
        first, last = F.floor(F.col("start_us") / self.slot_us), F.floor(F.col("end_us") / self.slot_us)
        spans = new.groupBy(first.alias("slot")).agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi"), F.max(last).alias("last")).collect()  # a row per slot
        if not spans:
            scratch.close()
            return False
        own = {s for r in spans for s in range(r["slot"], r["last"] + 1)}  # slots that may be rewritten are read whole
        near = [k for k, v in self.slots.items() if k in own or any(v["end"] >= r["lo"] - gap and v["start"] <= r["hi"] + gap for r in spans)]
        tagged = new.withColumn("fresh", F.lit(1)).unionByName(self.read(near).withColumn("fresh", F.lit(0)))
        low = F.array_sort(F.collect_set(F.floor(F.col("start_us") / self.slot_us))).alias("from_slots")  # one entry per slot at most
        merged = bridge(tagged, self.gap_s, F.max("fresh").alias("fresh"), low).withColumn("slot", F.floor(F.col("start_us") / self.slot_us))
        folder = self.versions.folder("sessions")
        merged.write.partitionBy("slot").parquet(home.path(folder))
        got = home.spark.read.schema(merged.schema).parquet(home.path(folder))
        stats = got.groupBy("slot").agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi"), F.max("fresh").alias("fresh"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("fresh") == 1, F.col("from_slots"))))).alias("moved")).collect()  # a row per slot
        moved = {s for r in stats for s in r.moved or []}
        slots = self.slots
        for k in moved:  # a slot all of whose sessions were bridged into an earlier one has no rows any more
            slots.pop(k, None)
        for r in stats:
            if r.fresh or r.slot in moved:
                slots[r.slot] = {"path": f"{folder}/slot={r.slot}", "start": r.lo, "end": r.hi}
        self.versions.commit({str(k): v for k, v in slots.items()}, batch_id)
        scratch.close()
        return True

    def vacuum(self) -> None:
        self.versions.vacuum()


def batches(df: DataFrame, column: str, rounds: int) -> list[DataFrame]:
    """``df`` as at most ``rounds`` successive batches by ranges of an arrival number; together they hold every row once.

    Rows with a null number go with the first batch.
    """
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return [df]
    edges = sorted({lo + (hi - lo + 1) * i // rounds for i in range(1, rounds)} - {lo})
    out = []
    for a, b in zip([None, *edges], [*edges, None]):
        keep = F.lit(True)
        if a is not None:
            keep &= F.col(column) >= a
        if b is not None:
            keep &= F.coalesce(F.col(column) < b, F.lit(a is None))
        out.append(df.filter(keep))
    return out
