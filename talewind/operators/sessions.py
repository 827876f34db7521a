"""Sessions of canonical events: process trees, logons, and what is left by inactivity gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talewind.operators.hierarchy import hierarchy
from talewind.operators.parse import ZERO_GUID, edges, either, entities, entity_id, entity_kind, get, once
from talewind.operators.session_store import bridge, local_sessions
from talewind.spool import Spool

# Built-in logons, compared without case.
WELL_KNOWN = ("0x0", "0x3e7", "0x3e4", "0x3e5")


def slim(events: DataFrame, *keep: str) -> DataFrame:
    """``(seq, host, ts, event_id, guid, parent, source, lid, *keep)``: all that sessions are built from, without the records.

    ``guid`` and ``parent`` are those a creation record names, ``source`` the process that acted in another event.
    """
    if "record" not in events.columns:
        return events
    e, text = F.col("event_id"), lambda c: F.nullif(F.trim(c), F.lit(""))
    parent = text(get("ParentProcessGuid"))
    lid = F.coalesce(*(F.when(~F.lower(get(k)).isin(*WELL_KNOWN), get(k)) for k in ("TargetLogonId", "LogonId", "SubjectLogonId")))
    return once(
        events, "seq", "host", "ts", "event_id", *keep, guid=F.when(e == 1, text(get("ProcessGuid"))), parent=F.when((e == 1) & (parent != ZERO_GUID), parent),
        source=F.when(e.isin(3, 7, 11, 12, 13), F.trim(get("ProcessGuid"))).when(e == 10, F.trim(either("SourceProcessGUID", "SourceProcessGuid"))), lid=lid)


def process_nodes(events: DataFrame) -> DataFrame:
    """``(host, guid, seq, ts, parent)``: the last creation record of each (host, guid); guids are trimmed, case counts."""
    made = slim(events).filter("guid is not null")
    return made.groupBy("host", "guid").agg(F.max_by(F.struct("seq", "ts", "parent"), F.struct("ts", "seq")).alias("r")).select("host", "guid", "r.*")


def process_trees(nodes: DataFrame, spool: Spool) -> DataFrame:
    """``(host, guid, seq, ts, parent, root_seq, is_root, is_orphan)``; nodes on or below a loop have no root."""
    up = nodes.select("host", F.col("guid").alias("parent"), F.col("seq").alias("p"))
    linked = spool.cut(nodes.join(up, ["host", "parent"], "left"), "nodes")
    tree = hierarchy(linked.select(F.col("seq").alias("k"), "p", "host"), spool, block_by="host").select(F.col("k").alias("seq"), F.col("root").alias("root_seq"))
    return linked.join(tree, "seq").select(
        "host", "guid", "seq", "ts", "parent", "root_seq", (F.col("root_seq") == F.col("seq")).alias("is_root"), (F.col("parent").isNotNull() & F.col("p").isNull()).alias("is_orphan"))


def attach(events: DataFrame, trees: DataFrame) -> DataFrame:
    """``(seq, root_seq)`` of the events a tree owns: its creation records and what its processes did."""
    rooted = trees.filter("root_seq is not null")
    did = slim(events).filter("source is not null").select("seq", "host", F.col("source").alias("guid")).join(rooted.select("host", "guid", "root_seq"), ["host", "guid"])
    return did.select("seq", "root_seq").unionByName(rooted.select("seq", "root_seq"))


def build_sessions(events: DataFrame, spool: Spool, gap_s: int = 300, trees: DataFrame | None = None) -> DataFrame:
    """``(seq, kind, session, host, ts, event_id)``: every event in exactly one session.

    ``kind`` is tree, logon or gap; ``session`` is the smallest sequence number of the session's kind-specific key (the
    root's creation record for trees, the first event for the others).  Time never splits trees and logons; a gap of
    exactly ``gap_s`` does not split the rest.  The records themselves are read once, for their few ids;
    ``events`` may be a written table of :func:`slim` too, with more columns.
    """
    if "record" in events.columns:
        events = spool.cut(slim(events), "slim")
    trees = process_trees(process_nodes(events), spool) if trees is None else trees
    every = spool.cut(events.select("seq", "host", "ts", "event_id", "lid").join(attach(events, trees), "seq", "left"), "owned")
    rest = every.filter("root_seq is null").withColumn("ts_us", F.unix_micros("ts"))
    logon = rest.filter("lid is not null")
    first = logon.groupBy("host", "lid").agg(F.min("seq").alias("session"))
    gaps = rest.filter("lid is null")
    local = local_sessions(gaps, ["host"], gap_s).withColumnRenamed("host", "key")
    whole = bridge(local, gap_s).select(F.col("key").alias("host"), "start_us", "end_us", F.col("min_seq").alias("session"))
    # an event lies in the one session of its host that spans it: both meet in the buckets the session covers
    bucket = 21_600_000_000
    spans = whole.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_us") / bucket), F.floor(F.col("end_us") / bucket))))
    placed = gaps.withColumn("b", F.floor(F.col("ts_us") / bucket)).join(spans, ["host", "b"]).filter("ts_us between start_us and end_us")
    keep = ["host", "ts", "event_id"]
    return (
        every.filter("root_seq is not null").select("seq", F.lit("tree").alias("kind"), F.col("root_seq").alias("session"), *keep)
        .unionByName(logon.join(first, ["host", "lid"]).select("seq", F.lit("logon").alias("kind"), "session", *keep))
        .unionByName(placed.select("seq", F.lit("gap").alias("kind"), "session", *keep))
    )


def kind_rank() -> Column:
    """Trees before logons before gap sessions."""
    return F.when(F.col("kind") == "tree", 0).when(F.col("kind") == "logon", 1).otherwise(2)


def session_table(members: DataFrame) -> DataFrame:
    """``(kind, session, host, start, end, n_events, kind_rank)``; the order of (kind_rank, session) is the output order."""
    return members.groupBy("kind", "session").agg(
        F.min("host").alias("host"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_events"), F.min(kind_rank()).alias("kind_rank"))


def with_position(sessions: DataFrame, spool: Spool) -> DataFrame:
    """``sessions`` with ``position``: their dense number, from 0, in the order of kind and first event."""
    order = ["kind_rank", "session"]
    ranked = spool.cut(sessions.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    return dense(ranked, "_at", "position")


def dense(ranked: DataFrame, at: str, name: str) -> DataFrame:
    """A written table's task-wise numbers ``at`` as dense ones ``name``, from 0; one row per task reaches the driver."""
    sizes = ranked.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    start, rows = 0, []
    for r in sizes:
        rows.append((r.part, start))
        start += r.n
    off = ranked.sparkSession.createDataFrame(rows, "_part long, _off long")
    return ranked.withColumn("_part", F.shiftright(at, 33)).join(F.broadcast(off), "_part").withColumn(name, F.col("_off") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_off", at)


def tree_stats(trees: DataFrame) -> DataFrame:
    """``(nodes, roots, orphans)`` of :func:`process_trees`."""
    return trees.agg(F.count("*").alias("nodes"), F.count_if("is_root").alias("roots"), F.count_if("is_orphan").alias("orphans"))


def session_stats(sessions: DataFrame) -> DataFrame:
    """Per kind: sessions, events, and mean, median, 95th percentile, largest and smallest size (linear interpolation)."""
    size = F.col("n_events").cast("double")
    return sessions.groupBy("kind").agg(
        F.count("*").alias("sessions"), F.sum("n_events").alias("events"), F.avg(size).alias("mean_size"), F.percentile(size, 0.5).alias("median_size"), F.percentile(size, 0.95).alias("p95_size"), F.max("n_events").alias("max_size"), F.min("n_events").alias("min_size"))


def gap_audit(events: DataFrame, gap_s: int, bucket_s: int = 86_400) -> DataFrame:
    """Per host of ``(host, ts_us, seq)``: seconds covered, largest, mean and median pause, and pauses beyond the limit.

    Pauses are taken inside (host, time bucket), and between buckets from one row each, so that a host of any size is
    spread over its buckets.  Equal pauses are counted before the shuffle.
    """
    w = Window.partitionBy("host", "bucket").orderBy("ts_us", "seq")
    rows = events.withColumn("bucket", F.floor(F.col("ts_us") / (bucket_s * 1_000_000)))
    inner = rows.select("host", (F.col("ts_us") - F.lag("ts_us").over(w)).alias("gap"))
    ends = rows.groupBy("host", "bucket").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    over = ends.select("host", "lo", "hi", (F.col("lo") - F.lag("hi").over(Window.partitionBy("host").orderBy("bucket"))).alias("gap"))
    none = F.lit(None).cast("long")
    every = inner.filter("gap is not null").select("host", none.alias("lo"), none.alias("hi"), "gap").unionByName(over)
    c = every.groupBy("host", "gap").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    gap, n = F.col("gap") / 1_000_000, F.when(F.col("gap").isNotNull(), F.col("n"))
    return c.groupBy("host").agg(
        ((F.max("hi") - F.min("lo")) / 1_000_000).alias("duration_s"), F.max(gap).alias("max_gap"), (F.sum(F.col("gap") * n) / F.sum(n) / 1_000_000).alias("mean_gap"),
        F.percentile(gap, 0.5, F.coalesce(n, F.lit(0))).alias("median_gap"), F.coalesce(F.sum(F.when(gap > gap_s, n)), F.lit(0)).alias("n_over"))


def session_entities(events: DataFrame, members: DataFrame) -> DataFrame:
    """``(session, kind, entity_id, attributes, seq)``: per session and entity the description that came last."""
    e = entities(events).join(members.select("seq", "session"), "seq")
    return e.groupBy("session", "kind", "entity_id").agg(F.max_by(F.struct("attributes", "seq"), F.struct("ts", "seq")).alias("r")).select("session", "kind", "entity_id", "r.*")


def session_edges(events: DataFrame, members: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(session, src, rel, dst, first_seq)``: distinct edges both of whose ends are entities of the session.

    ``known`` has the entities ``(session, entity_id)`` where they were cut before; else their ids alone are cut here.
    An edge's own event describes its ``dst``, which so is an entity of the session.
    """
    session = members.select("seq", "session")
    if known is None:
        known = once(events.filter(entity_kind().isNotNull()), "seq", entity_id=entity_id()).join(session, "seq")
    known = known.select("session", F.col("entity_id").alias("src")).distinct()
    found = edges(events).join(session, "seq").groupBy("session", "src", "rel", "dst").agg(F.min_by("seq", F.struct("ts", "seq")).alias("first_seq"))
    return found.join(known, ["session", "src"], "left_semi")


def ownership_violations(members: DataFrame) -> DataFrame:
    """Events in more than one session; always empty."""
    return members.groupBy("seq").agg(F.count("*").alias("n")).filter("n > 1")


def event_histogram(members: DataFrame) -> DataFrame:
    return members.groupBy("kind", "session", "event_id").agg(F.count("*").alias("n"))
