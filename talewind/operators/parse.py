"""Raw endpoint records to canonical events, entities and relationship edges.

A record is a map of strings.  Every record gets a ``reason``: null where it is kept, else why it is dropped; counts
are aggregates over that column, so a retried task never counts twice.  Present-but-null values count as absent.
"""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampType

# Supported event ids, time fields in order of preference, the guid that names no parent.
SUPPORTED = (1, 3, 7, 10, 11, 12, 13, 4103, 4104, 4624)
TIME_FIELDS = ("@timestamp", "UtcTime", "EventTime", "SystemTime")
ZERO_GUID = "{00000000-0000-0000-0000-000000000000}"
COUNTED = ("malformed", "no_parser", "no_timestamp", "bad_timestamp")


def get(key: str, record: str = "record") -> Column:
    """Value of a key, null where missing or empty."""
    return F.nullif(F.col(record)[key], F.lit(""))


def either(*keys: str) -> Column:
    """First non-empty value."""
    return F.coalesce(*(get(k) for k in keys))


#: Spellings of a time with a date besides ISO 8601, most frequent first; a leading day of the week is left out.
TIME_FORMATS = (
    "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "MMM d yyyy HH:mm:ss", "MMM d yyyy HH:mm", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy h:mm:ss a", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss Z", "MMM d HH:mm:ss yyyy",
    "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "M/d/yyyy H:mm", "M/d/yyyy", "yyyyMMdd'T'HHmmss", "yyyyMMddHHmmss", "dd/MMM/yyyy:HH:mm:ss Z",
)


def parse_time(text: Column) -> Column:
    """UTC instant of the spellings in use; times without a date and unreadable ones are null."""
    dated = F.when(text.rlike(r"\d{4}|\d/\d"), F.trim(text))
    bare = F.regexp_replace(dated, r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +", "")
    return F.coalesce(dated.try_cast("timestamp"), *(F.try_to_timestamp(bare, F.lit(f)) for f in TIME_FORMATS))


def any_time(text: Column) -> Column:
    """:func:`parse_time`, and a general date parser for dated texts it can't read; a text without a day is no time."""
    known = parse_time(text)
    return F.coalesce(known, _general_time(F.when(known.isNull() & text.rlike(r"\d{4}"), text)))


@F.pandas_udf(TimestampType())
def _general_time(text: pd.Series) -> pd.Series:
    from dateutil import parser

    def one(t: str | None):
        if t is None:
            return None
        try:
            a, b = (parser.parse(t, default=datetime(2000, m, d)) for m, d in ((1, 1), (2, 2)))
        except (ValueError, OverflowError, TypeError):
            return None
        if a.date() != b.date():  # the text names no full date
            return None
        return (a.replace(tzinfo=timezone.utc) if a.tzinfo is None else a.astimezone(timezone.utc)).replace(tzinfo=None)

    return pd.Series([one(t) for t in text], dtype="datetime64[us]")


def once(df: DataFrame, *keep: str, **cols: Column) -> DataFrame:
    """``df`` (or its columns ``keep``) with columns that are computed once per row, however often later steps refer to them.

    A projection could be copied into every expression and filter above it; a one-row generator can't.
    """
    return df.select(*(keep or df.columns), F.inline(F.array(F.struct(*(c.alias(k) for k, c in cols.items())))))


def parse(records: DataFrame, *keep: str, general: bool = False) -> DataFrame:
    """``(seq, record, *keep)`` to ``(seq, event_id, ts, host, event_source_id, provider, channel, record, reason, *keep)``.

    ``general`` has a general date parser read what the known spellings don't cover, in Arrow batches.

    Reasons in order: ``malformed`` (EventID is no integer), ``no_parser`` (not supported), ``silent_mismatch`` (the
    number is spelled in an unusual way; not part of the reported totals), ``no_timestamp``, ``bad_timestamp``.
    """
    raw = F.col("record")["EventID"]
    whole = F.when(F.trim(raw).rlike(r"^[+-]?\d+(\.\d+)?$"), F.trim(raw).try_cast("double").try_cast("int"))
    text = either(*TIME_FIELDS)
    security, shell = F.col("event_id") == 4624, F.col("event_id").isin(4103, 4104)
    by_parser = lambda s, p, o: F.when(security, s).when(shell, p).otherwise(o)
    return (
        once(once(records.select("seq", "record", *keep), event_id=whole, time_text=text), ts=(any_time if general else parse_time)(F.col("time_text")))
        .select(
            "seq", "event_id", "ts", F.coalesce(either("Hostname", "Computer"), F.lit("Unknown")).alias("host"),
            F.coalesce(either("RecordNumber", "EventRecordID"), F.lit("")).alias("event_source_id"),
            F.coalesce(F.col("record")["Provider_Name"], by_parser("Microsoft-Windows-Security-Auditing", "Microsoft-Windows-PowerShell", "Microsoft-Windows-Sysmon")).alias("provider"),
            F.coalesce(F.col("record")["Channel"], by_parser("Security", "Microsoft-Windows-PowerShell/Operational", "Microsoft-Windows-Sysmon/Operational")).alias("channel"),
            "record",
            F.when(F.col("event_id").isNull(), "malformed").when(~F.col("event_id").isin(*SUPPORTED), "no_parser").when(raw != F.col("event_id").cast("string"), "silent_mismatch")
            .when(F.col("time_text").isNull(), "no_timestamp").when(F.col("ts").isNull(), "bad_timestamp").alias("reason"), *keep)
    )


def kept(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is null").drop("reason")


def drop_counts(parsed: DataFrame) -> DataFrame:
    """``(reason, event_id, n)`` of dropped records; malformed ones have no event id."""
    return parsed.filter("reason is not null").groupBy("reason", F.when(F.col("reason") != "malformed", F.col("event_id")).alias("event_id")).agg(F.count("*").alias("n"))


def hashes(text: Column) -> Column:
    """``"SHA1=..,MD5=.."`` as a map: split at the first '=', trimmed, last of equal keys wins; null where empty."""
    pairs = F.transform(F.filter(F.split(text, ","), lambda p: p.contains("=")), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + F.lit(2), F.size(pairs)), lambda q: q.k == p.k))
    return F.when(F.size(last) > 0, F.map_from_entries(last))


def epoch_text(ts: Column) -> Column:
    """Seconds since the epoch as shortest decimal text with at least one decimal place."""
    s = F.regexp_replace((F.unix_micros(ts).cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)").cast("string"), "0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def extension(path: Column) -> Column:
    """Text after the last dot of the whole path; empty where there is no dot."""
    return F.when(path.contains("."), F.substring_index(path, ".", -1)).otherwise("")


def owner() -> Column:
    """Id of the process a record belongs to; null where it names none."""
    return F.when(get("ProcessGuid").isNotNull(), F.concat(F.lit("proc_"), get("ProcessGuid"))).when(get("ProcessId").isNotNull(), F.concat_ws("_", F.lit("proc"), F.lower("host"), get("ProcessId"), epoch_text(F.col("ts"))))


def _number(c: Column, default: Column) -> Column:
    return F.coalesce(F.when(c.rlike("^[0-9]+$"), c.try_cast("int")), default)


def _attributes(**kw: Column) -> Column:
    return F.map_filter(F.create_map(*(x for k, v in kw.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())


def entity_kind() -> Column:
    """Kind of the entity an event describes; null where it describes none."""
    e = F.col("event_id")
    return F.when(e.isin(1, 10), "process").when(e == 3, "network").when(e.isin(7, 11), "file").when(e.isin(12, 13), "registry").when(e == 4624, "user")


def entity_id() -> Column:
    """Id of the entity an event describes; null where it describes none."""
    e, r, host, blank = F.col("event_id"), F.col("record"), F.lower("host"), F.lit("")
    text = lambda k: F.coalesce(r[k], blank)
    tguid = either("TargetProcessGUID", "TargetProcessGuid")
    process = F.when(get("ProcessGuid").isNotNull(), F.concat(F.lit("proc_"), get("ProcessGuid"))).otherwise(F.concat_ws("_", F.lit("proc"), host, F.coalesce(r["ProcessId"], F.lit("None")), epoch_text(F.col("ts"))))
    target = F.when(tguid.isNotNull(), F.concat(F.lit("proc_"), tguid)).otherwise(F.concat_ws("_", F.lit("proc"), host, F.coalesce(r["TargetProcessId"], F.lit("None")), F.lit("access")))
    flow = F.concat_ws("_", F.lit("net"), text("SourceIp"), text("DestinationIp"), F.coalesce(r["SourcePort"], F.lit("0")), F.coalesce(r["DestinationPort"], F.lit("0")), text("Protocol"), F.date_format("ts", "yyyyMMddHHmm"))
    user = F.when(_user("UserSid") != "", F.concat(F.lit("user_"), _user("UserSid"))).otherwise(F.lower(F.concat(F.lit("user_"), _user("DomainName"), F.lit("\\"), _user("UserName"))))
    return (
        F.when(e == 1, process).when(e == 3, flow).when(e == 7, F.concat_ws("_", F.lit("file"), host, text("ImageLoaded"))).when(e == 10, target)
        .when(e == 11, F.concat_ws("_", F.lit("file"), host, text("TargetFilename"))).when(e.isin(12, 13), F.concat_ws("_", F.lit("reg"), host, text("TargetObject"))).when(e == 4624, user))


def _user(k: str) -> Column:
    return F.coalesce(either(f"Target{k}", f"Subject{k}"), F.lit(""))


def entity_attributes() -> Column:
    """What an event says about its entity, as a map of the values that are there."""
    e, r, blank = F.col("event_id"), F.col("record"), F.lit("")
    text = lambda k: F.coalesce(r[k], blank)
    tguid = either("TargetProcessGUID", "TargetProcessGuid")
    parts = F.split(text("TargetObject"), r"\\", -1)
    loaded, created = text("ImageLoaded"), text("TargetFilename")
    return (
        F.when(e == 1, _attributes(
            guid=r["ProcessGuid"], pid=F.coalesce(F.trim(r["ProcessId"]).try_cast("int"), F.lit(0)), image=text("Image"), command_line=r["CommandLine"],
            parent_guid=r["ParentProcessGuid"], parent_image=r["ParentImage"], user=r["User"], integrity=r["IntegrityLevel"],
            hashes=F.to_json(hashes(r["Hashes"])), company=r["Company"], original_filename=r["OriginalFileName"]))
        .when(e == 3, _attributes(source_ip=text("SourceIp"), dest_ip=text("DestinationIp"), source_port=_number(r["SourcePort"], F.lit(0)), dest_port=_number(r["DestinationPort"], F.lit(0)), protocol=text("Protocol")))
        .when(e == 7, _attributes(path=loaded, type=F.when(F.lower(extension(loaded)).isin("dll", "sys"), "Module").otherwise("File"), extension=extension(loaded), hashes=F.to_json(hashes(r["Hashes"]))))
        .when(e == 10, _attributes(guid=tguid, pid=F.coalesce(F.trim(r["TargetProcessId"]).try_cast("int"), F.lit(0)), image=text("TargetImage"), parent_image=r["SourceImage"]))
        .when(e == 11, _attributes(path=created, type=F.when(F.lower(extension(created)).isin("exe", "dll", "sys"), "Executable").otherwise("Document"), extension=extension(created)))
        .when(e.isin(12, 13), _attributes(
            hive=parts[0],
            key_path=F.when((e == 13) & (F.size(parts) > 2), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "\\")).otherwise(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "\\")),
            value_name=F.when(e == 13, F.element_at(parts, -1)), operation=F.when(r["EventType"].isin("DeleteKey", "DeleteValue"), "Delete").when(e == 12, "Create").otherwise("Set")))
        .when(e == 4624, _attributes(
            sid=_user("UserSid"), account=_user("UserName"), domain=_user("DomainName"), logon_id=r["TargetLogonId"], logon_type=_number(r["LogonType"], F.lit(None).cast("int")),
            authentication_package=r["AuthenticationPackageName"], elevated=F.coalesce(r["ElevatedToken"] == "%%1842", F.lit(False))))
    )


def entities(events: DataFrame, *keep: str) -> DataFrame:
    """``(seq, host, ts, event_id, kind, entity_id, attributes, *keep)``: the entity each kept event describes, at most one."""
    some = events.withColumn("kind", entity_kind()).filter("kind is not null")
    return once(some, "seq", "host", "ts", "event_id", "kind", *keep, entity_id=entity_id(), attributes=entity_attributes()).select("seq", "host", "ts", "event_id", *keep, "kind", "entity_id", "attributes")


def edges(events: DataFrame, *keep: str) -> DataFrame:
    """``(seq, host, ts, src, rel, dst, *keep)``: the relationship each kept event states, at most one."""
    e = F.col("event_id")
    parent = F.trim(F.coalesce(get("ParentProcessGuid"), F.lit("")))
    sguid, spid = either("SourceProcessGUID", "SourceProcessGuid"), get("SourceProcessId")
    src = (
        F.when((e == 1) & (parent != "") & (parent != ZERO_GUID), F.concat(F.lit("proc_"), parent))
        .when(e == 10, F.when(sguid.isNotNull(), F.concat(F.lit("proc_"), sguid)).when(spid.isNotNull(), F.concat_ws("_", F.lit("proc"), F.lower("host"), spid)))
        .when(e.isin(3, 7, 11, 12, 13), owner())
    )
    # The relationship each event id states.
    rel = F.when(e == 1, "spawned").when(e == 3, "connected_to").when(e == 7, "loaded").when(e == 10, "accessed_process").when(e == 11, "created_file").when(e.isin(12, 13), "modified_registry")
    return once(events.filter(e.isin(1, 3, 7, 10, 11, 12, 13)), "seq", "host", "ts", *keep, src=src, rel=rel, dst=entity_id()).filter("src is not null").select("seq", "host", "ts", "src", "rel", "dst", *keep)
