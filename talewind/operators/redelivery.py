"""Exactly one copy of every message that was delivered at least once.

A message is identified by its uuid, and by (host, channel, record number, time).  For the record numbers of a
producer (host and channel) the disjoint ranges seen so far are kept, in blocks of numbers, so that a producer with
a large share of all rows is spread over many tasks.  A number outside every range is new: it is accepted without any
look at stored keys, and its range grows.  Numbers inside a range (repeats, or a producer that counts anew) and
identifiers that are no plain number are resolved by exact lookup of the stored keys; so are uuids, since a copy may
share only its uuid.

The state is a folder of tables that are only added to, and a numbered manifest: keys with the smallest seq of each,
in buckets by a hash of the key, ranges of the blocks a batch touched, and the links found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from talewind.functions.normalize import guid_key, host_key, number_key
from talewind.operators.components import components
from talewind.operators.session_store import Versions
from talewind.spool import Home, Spool, small

#: Numbers per block of a producer's seen ranges.
BLOCK = 4096
_PRODUCER = ["host", "channel", "block"]
_RANGES = "host string, channel string, block long, ranges array<struct<lo:long,hi:long>>"
_KEYS = "kind string, key binary, first long, n long, look boolean, bucket int"
_LINKS = "a long, b long"


def identified(events: DataFrame) -> DataFrame:
    """``(seq, uuid, host, channel, number, plain, ts_us)``; ``plain`` is the number where it is a whole one that can be ranged."""
    number = number_key(F.col("event_source_id"))
    base = events.select(
        F.col("seq").cast("long").alias("seq"), F.unhex(guid_key(F.col("event_uuid"))).alias("uuid"), host_key(F.col("host")).alias("host"),
        F.col("channel"), number.alias("number"), F.unix_micros(F.col("timestamp")).alias("ts_us"))
    whole = F.expr("host is not null and channel is not null and number is not null and ts_us is not null")
    plain = F.when(whole & (F.col("number") == F.floor("number")) & F.col("number").between(-(2**62), 2**62), F.col("number").cast("long"))
    return base.withColumn("plain", plain)


def merged_ranges(ranges: Column) -> Column:
    """Disjoint maximal ranges, in order, of an array of ranges ``(lo, hi)`` that may touch or overlap."""
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.lo.alias("lo"), F.greatest(last.hi, r.hi).alias("hi"))))
        return F.when((F.size(done) > 0) & (r.lo <= F.get(done, F.size(done) - 1).hi + 1), joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def ranges_of(numbers: DataFrame) -> DataFrame:
    """Disjoint maximal ranges ``(host, channel, block, ranges)`` of ``(host, channel, block, plain)``."""
    s = F.col("s")
    low = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1) < x - 1))
    high = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) > x + 1))
    sets = numbers.groupBy(*_PRODUCER).agg(F.array_sort(F.collect_set("plain")).alias("s"))  # at most BLOCK numbers
    return sets.select(*_PRODUCER, F.zip_with(low, high, lambda x, y: F.struct(x.alias("lo"), y.alias("hi"))).alias("ranges"))


def covered(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rows`` with ``seen``: whether the plain number lies in a stored range of its producer (true where there is none to range)."""
    inside = F.exists("ranges", lambda r: (F.col("plain") >= r.lo) & (F.col("plain") <= r.hi))
    return rows.join(ranges, _PRODUCER, "left").withColumn("seen", F.col("plain").isNull() | F.coalesce(inside, F.lit(False))).drop("ranges")


def keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """``(seq, kind, key, look, bucket)``: the up to two keys of a row; ``look`` where the stored keys may hold it."""
    text = [F.col("host"), F.col("channel")]
    place = F.concat(*(x for t in text for x in (F.length(t).cast("string"), F.lit(":"), t)), F.lit("|"), F.col("number").cast("string"), F.lit("|"), F.col("ts_us").cast("string"))  # no two places share a text
    key = lambda kind, k, look: F.struct(F.lit(kind).alias("kind"), k.cast("binary").alias("key"), look.alias("look"))
    both = F.array(key("uuid", F.col("uuid"), F.lit(True)), key("place", place, F.col("seen")))
    return rows.select("seq", F.inline(F.filter(both, lambda x: x.key.isNotNull()))).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


class SeenMessages:
    """Stored state of one stream below ``home``."""

    def __init__(self, home: Home, buckets: int = 16):
        self.home, self.versions = home, Versions(home)
        self.buckets = self.versions.state.get("buckets", buckets)

    def _read(self, what: str, schema: str) -> DataFrame:
        spark = self.home.spark
        paths = [self.home.path(x) for x in self.versions.state.get(what, [])]
        frames = [spark.read.schema(schema).parquet(p).withColumn("version", F.lit(i)) for i, p in enumerate(paths)]
        return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema).withColumn("version", F.lit(0))

    def ranges(self) -> DataFrame:
        """``(host, channel, block, ranges)``: what the last batch that touched a block left."""
        return self._read("ranges", _RANGES).groupBy(*_PRODUCER).agg(F.max_by("ranges", "version").alias("ranges"))

    def ingest(self, batch: DataFrame, batch_id: int | None = None) -> bool:
        """Take in a batch of :func:`identified` rows and remember which of them repeat a message.

        A batch number that was taken in before is left out, and the result is false.  Rows of a replay without a
        number link nothing new.
        """
        if batch_id is not None and batch_id in self.versions.taken:
            return False
        home, state, sp = self.home, self.versions.state, Spool(self.home.spark, "ingest")
        rows = batch.withColumn("block", F.expr(f"plain div {BLOCK}") - F.when(F.expr(f"plain < 0 and plain % {BLOCK} <> 0"), 1).otherwise(0))
        known = sp.cut(self.ranges(), "ranges") if state.get("ranges") else None
        rows = sp.cut(rows.withColumn("seen", F.col("plain").isNull()) if known is None else covered(rows, small(known)), "batch")
        keys = keyed(rows, self.buckets)
        folder = {what: self.versions.folder(what) for what in ("keys", "ranges", "links")}
        one = keys.groupBy("bucket", "kind", "key").agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.max("look").alias("look"))
        one.write.partitionBy("bucket").parquet(home.path(folder["keys"]))
        new = home.spark.read.schema(_KEYS).parquet(home.path(folder["keys"]))
        twice = new.filter("n > 1").select("kind", "key", "first", F.lit(None).cast("long").alias("old"))
        if state.get("keys"):
            touched = [int(x.split("=")[1]) for x in home.names_in(folder["keys"]) if x.startswith("bucket=")]
            old = self._read("keys", _KEYS).filter(F.col("bucket").isin(touched)).select("kind", "key", F.col("first").alias("old"))
            twice = twice.unionByName(new.filter("look").select("kind", "key", "first").join(old, ["kind", "key"]))
        twice = twice.groupBy("kind", "key").agg(F.min("first").alias("first"), F.min("old").alias("old"))
        twice = sp.cut(twice.select("kind", "key", F.least("first", "old").alias("b"), "first", "old"), "twice")
        # copies of one message meet its key in a broadcast, or in a join whose large partitions are split at run time
        links = keys.join(small(twice).select("kind", "key", "b"), ["kind", "key"]).select(F.col("seq").alias("a"), "b")
        turned = twice.filter("old > first").select(F.col("old").alias("a"), "b")  # the smallest seq of a stored message came now
        links.unionByName(turned).filter("a <> b").write.parquet(home.path(folder["links"]))
        fresh = ranges_of(rows.filter("plain is not null and not seen"))
        if known is not None:
            before = known.withColumnRenamed("ranges", "before")
            fresh = fresh.join(before, _PRODUCER, "left").select(*_PRODUCER, merged_ranges(F.concat("ranges", F.coalesce("before", F.array().cast("array<struct<lo:bigint,hi:bigint>>")))).alias("ranges"))
        fresh.write.parquet(home.path(folder["ranges"]))
        self.versions.commit({"buckets": self.buckets, **{k: state.get(k, []) + [v] for k, v in folder.items()}}, batch_id)
        sp.close()
        return True

    def compact(self) -> None:
        """Rewrite keys, ranges and links as one folder each; earlier folders stay until :meth:`vacuum`."""
        if not self.versions.state:
            return
        folder = {what: self.versions.folder(what) for what in ("keys", "ranges", "links")}
        keys = self._read("keys", _KEYS).groupBy("bucket", "kind", "key").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.max("look").alias("look"))
        keys.write.partitionBy("bucket").parquet(self.home.path(folder["keys"]))
        self.ranges().write.parquet(self.home.path(folder["ranges"]))
        self._read("links", _LINKS).drop("version").distinct().write.parquet(self.home.path(folder["links"]))
        self.versions.commit({"buckets": self.buckets, **{k: [v] for k, v in folder.items()}}, None)

    def vacuum(self) -> None:
        self.versions.vacuum()

    def copies(self) -> DataFrame:
        """``(kept_seq, dup_seq)``: for every surplus copy the smallest seq of its message; copies of copies are copies."""
        links = self._read("links", _LINKS).select("a", "b")
        return components(links, Spool(self.home.spark, "copies")).select(F.col("root").alias("kept_seq"), F.col("v").alias("dup_seq"))
