"""Queries of the general training-data operators over the event and process tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talewind.functions.normalize import first_logon, guid_key, host_key, logon_key, strip
from talewind.operators.entity_features import entity_features
from talewind.operators.hierarchy import hierarchy
from talewind.operators.redelivery import SeenMessages, identified
from talewind.operators.session_store import SessionStore, batches, local_sessions
from talewind.sources.tables import table
from talewind.spool import Spool, small


# ---- 1: hierarchies -------------------------------------------------------------------------------------------
def processes(spark: SparkSession, sf: str) -> DataFrame:
    """``(k, p, host)``: one row per process (host, guid), the latest record's key, and the key of its parent process.

    A record without host or guid is no process.  A missing recorded_at counts as the earliest.  If several listings
    name one process as their child, the listing process with the smallest guid counts.
    """
    rec = table(spark, sf, "process_entities").select(
        host_key(F.col("host")).alias("host"), guid_key(F.col("process_guid")).alias("guid"), guid_key(F.col("parent_guid")).alias("parent"),
        "proc_key", F.struct(F.coalesce(F.unix_micros("recorded_at"), F.lit(-(2**63))).alias("at"), "proc_key").alias("latest"))
    procs = rec.filter("host is not null and guid is not null").groupBy("host", "guid").agg(F.max_by(F.struct("proc_key", "parent"), "latest").alias("r")).select("host", "guid", F.col("r.proc_key").alias("k"), F.col("r.parent").alias("parent"))
    listed = (
        table(spark, sf, "process_nodes").select(host_key(F.col("host")).alias("host"), guid_key(F.col("guid")).alias("lister"), F.explode("children").alias("child"))
        .select("host", "lister", guid_key(F.col("child")).alias("guid")).filter("host is not null and lister is not null and guid is not null")
    )
    ids = procs.select("host", F.col("guid").alias("parent"), F.col("k").alias("p"))
    by_list = listed.join(ids.withColumnRenamed("parent", "lister"), ["host", "lister"]).groupBy("host", "guid").agg(F.min_by("p", "lister").alias("p2"))
    return procs.join(ids, ["host", "parent"], "left").join(by_list, ["host", "guid"], "left").select("k", F.coalesce("p", F.when(F.col("parent").isNull(), F.col("p2"))).alias("p"), "host")


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(processes(spark, sf), Spool(spark, "p1"), block_by="host")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select(F.col("k").alias("proc_key"), "path")


def p1_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select(F.col("k").alias("proc_key"), "depth", F.col("root").alias("root_key"), "descendants")


def p1_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Which processes lie below one: those of the same root with an ``enter`` between its ``enter`` and ``leave``."""
    return _tree(spark, sf).select(F.col("k").alias("proc_key"), F.col("root").alias("root_key"), "enter", "leave")


# ---- 2: sessions ----------------------------------------------------------------------------------------------
def session_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(seq, ts_us, host, logon, batch_id)`` of the events that have a time and a host."""
    ev = table(spark, sf, "canonical_events").filter("timestamp is not null and host is not null")
    return ev.select("seq", F.unix_micros("timestamp").alias("ts_us"), host_key(F.col("host")).alias("host"), first_logon(F.col("raw_event")).alias("logon"), "batch_id").filter("host is not null")


def logon_users(spark: SparkSession, sf: str) -> DataFrame:
    """``(host, logon, sid)``; of several sids of one logon the smallest counts, blank sids and unusable logons give none."""
    u = table(spark, sf, "user_entities").select(host_key(F.col("host")).alias("host"), logon_key(F.col("logon_id")).alias("logon"), F.nullif(strip(F.col("user_sid")), F.lit("")).alias("sid"))
    return u.filter("host is not null and logon is not null and sid is not null").groupBy("host", "logon").agg(F.min("sid").alias("sid"))


def stored_sessions(spark: SparkSession, sf: str, gap_s: int = 300, rounds: int = 3) -> DataFrame:
    """The session table after all batches of ``canonical_events`` have been taken in."""
    sp = Spool(spark, "p2")
    store, users = SessionStore(Spool(spark, "p2-store"), gap_s), sp.cut(logon_users(spark, sf), "users")
    key = F.when(F.col("sid").isNotNull(), F.concat_ws("|", "host", F.lit("user"), "sid")).when(F.col("logon").isNotNull(), F.concat_ws("|", "host", F.lit("logon"), "logon")).otherwise(F.concat_ws("|", "host", F.lit("device")))
    for i, batch in enumerate(batches(session_rows(spark, sf), "batch_id", rounds)):
        local = local_sessions(batch, ["host", "logon"], gap_s).join(small(users), ["host", "logon"], "left")
        store.ingest(local.select(key.alias("key"), "start_us", "end_us", "min_seq", "max_seq", "n_events"), i)
    return store.read()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return stored_sessions(spark, sf).select(F.col("min_seq").alias("first_seq"), F.col("max_seq").alias("last_seq"))


def p2_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return stored_sessions(spark, sf).select("key", "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1_000_000).alias("duration_s"), "n_events")


# ---- 4: redelivery --------------------------------------------------------------------------------------------
def p4_found(spark: SparkSession, sf: str, rounds: int = 2) -> DataFrame:
    seen = SeenMessages(Spool(spark, "p4"))
    ev = table(spark, sf, "canonical_events")
    for i, batch in enumerate(batches(ev, "batch_id", rounds)):
        seen.ingest(identified(batch), i)
    return seen.copies()


# ---- 5: features ----------------------------------------------------------------------------------------------
def typed_events(spark: SparkSession, sf: str) -> DataFrame:
    """``(entity, kind, ts_us, amount)``: host, event type, time, and PayloadBytes where it consists of digits only."""
    raw, bytes_ = F.col("raw_event"), F.col("raw_event")["PayloadBytes"]
    return table(spark, sf, "canonical_events").select(
        host_key(F.col("host")).alias("entity"), F.coalesce(F.col("event_id").cast("long"), strip(raw["EventID"]).try_cast("long")).alias("kind"),
        F.unix_micros("timestamp").alias("ts_us"), F.when(bytes_.rlike("^[0-9]+$"), bytes_).alias("amount"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return entity_features(typed_events(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select(F.col("entity").alias("host"), F.explode(F.map_keys("features")).alias("event_id"))


def p5_features(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf).select(F.col("entity").alias("host"), F.explode("features").alias("event_id", "f"))
    return f.select("host", "event_id", F.col("f.n").alias("n_rows"), F.unix_micros("f.latest").alias("latest_us"), F.col("f.total").try_cast("long").alias("total_bytes"))


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_intervals": p1_intervals, "p2_found": p2_found, "p2_sessions": p2_sessions, "p4_found": p4_found, "p5_found": p5_found, "p5_features": p5_features}

_HOST = r"nullif(lower(regexp_replace(split_part(regexp_replace({0}, '^\s+', ''), '.', 1), '\s+$', '')), '')"
_HEX = "regexp_replace(lower({0}), '[^0-9a-f]', '', 'g')"
_GUID = f"case when length({_HEX}) = 32 and {_HEX} <> repeat('0', 32) then {_HEX} end"


def _host(c: str) -> str:
    return _HOST.format(c)


def _guid(c: str) -> str:
    return _GUID.format(c)


def _logon(c: str) -> str:
    x = rf"regexp_replace(regexp_replace(lower(trim({c})), '^0x', ''), '^0+(.)', '\1')"
    return f"case when regexp_full_match({x}, '[0-9a-f]+') and {x} not in ('0', '3e7', '3e4', '3e5') then {x} end"


def _raw(k: str) -> str:
    return f"raw_event['{k}']"


_PROCS = f"""
rec as (select {_host('host')} host, {_guid('process_guid')} guid, {_guid('parent_guid')} parent, proc_key,
  row_number() over (partition by {_host('host')}, {_guid('process_guid')} order by recorded_at desc nulls last, proc_key desc) rn from process_entities),
procs as (select host, guid, parent, proc_key k from rec where rn = 1 and host is not null and guid is not null),
listed as (select {_host('host')} host, {_guid('guid')} lister, {_guid('child')} guid from (select host, guid, unnest(children) child from process_nodes)),
by_list as (select l.host, l.guid, min(p.k) p2 from listed l join procs p on p.host = l.host and p.guid = l.lister group by all),
nodes as (select c.k, coalesce(p.k, case when c.parent is null then b.p2 end) p from procs c
  left join procs p on p.host = c.host and p.guid = c.parent left join by_list b on b.host = c.host and b.guid = c.guid),
walk as (select k, k as root, cast(k as varchar) path, 0 depth from nodes where p is null
  union all select n.k, w.root, w.path || '/' || n.k, w.depth + 1 from walk w join nodes n on n.p = w.k)"""

_SESSIONS = f"""
ev as (select seq, epoch_us(timestamp) t, {_host('host')} host,
  coalesce({', '.join(_logon(_raw(k)) for k in ('TargetLogonId', 'LogonId', 'SubjectLogonId'))}) logon from canonical_events where timestamp is not null),
u as (select {_host('host')} host, {_logon('logon_id')} logon, min(user_sid) sid from user_entities where trim(user_sid) <> '' group by all),
keyed as (select seq, t, case when sid is not null then ev.host || '|user|' || sid when ev.logon is not null then ev.host || '|logon|' || ev.logon else ev.host || '|device' end as key
  from ev left join u on u.host = ev.host and u.logon = ev.logon where ev.host is not null),
cut as (select *, case when t - lag(t) over (partition by key order by t, seq) > 300000000 then 1 else 0 end c from keyed),
part as (select *, sum(c) over (partition by key order by t, seq rows unbounded preceding) s from cut)"""

_EVENT_KIND = "coalesce(event_id, try_cast(trim(raw_event['EventID']) as bigint))"

ORACLE = {
    "p1_found": f"with recursive {_PROCS} select n.k proc_key, coalesce(w.path, 'cycle') path from nodes n left join walk w on w.k = n.k",
    "p1_hierarchy": f"""with recursive {_PROCS},
up as (select k, k as anc from walk union all select u.k, n.p from up u join nodes n on n.k = u.anc where n.p is not null)
select n.k proc_key, w.depth depth, w.root root_key, d.n descendants from nodes n left join walk w on w.k = n.k
left join (select anc, count(*) - 1 n from up group by anc) d on d.anc = w.k""",
    "p2_found": f"with {_SESSIONS} select min(seq) first_seq, max(seq) last_seq from part group by key, s",
    "p2_sessions": f"with {_SESSIONS} select key, min(t) start_us, max(t) end_us, (max(t) - min(t)) / 1000000.0::double duration_s, count(*) n_events from part group by key, s",
    "p4_found": f"""with recursive m as (select seq, {_guid('event_uuid')} uuid, {_host('host')} host, channel, try_cast(trim(event_source_id) as decimal(38,6)) num, timestamp ts from canonical_events),
g1 as (select uuid, min(seq) f from m where uuid is not null group by uuid having count(*) > 1),
g2 as (select host, channel, num, ts, min(seq) f from m where host is not null and channel is not null and num is not null and ts is not null group by all having count(*) > 1),
e as (select seq a, f b from m join g1 using (uuid) union select seq, f from m join g2 using (host, channel, num, ts)),
s as (select a, b from e union select b, a from e),
r as (select a v, b w from s union select r.v, s.b from r join s on s.a = r.w)
select min(w) kept_seq, v dup_seq from r group by v having min(w) < v""",
    "p5_found": f"select distinct {_host('host')} host, cast({_EVENT_KIND} as bigint) event_id from canonical_events where {_host('host')} is not null and {_EVENT_KIND} is not null",
    "p5_features": f"""select {_host('host')} host, cast({_EVENT_KIND} as bigint) event_id, count(*) n_rows, max(epoch_us(timestamp)) latest_us,
try_cast(coalesce(sum(case when regexp_full_match(raw_event['PayloadBytes'], '[0-9]+') then cast(raw_event['PayloadBytes'] as hugeint) end), 0) as bigint) total_bytes
from canonical_events where {_host('host')} is not null and {_EVENT_KIND} is not null group by all""",
}
