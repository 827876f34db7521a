"""The fixed 103-column feature table of sessions, as one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The binaries, ports, registry patterns, event ids and file types the feature table counts.
BINARIES = (
    "powershell.exe", "cmd.exe", "wmic.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "cscript.exe", "wscript.exe", "schtasks.exe", "sc.exe", "net.exe", "net1.exe", "lsass.exe",
    "svchost.exe", "services.exe", "wmiprvse.exe", "msbuild.exe", "installutil.exe", "cmstp.exe", "hh.exe", "control.exe", "msiexec.exe", "dllhost.exe", "mavinject.exe",
    "taskhost.exe", "taskhostw.exe", "conhost.exe", "explorer.exe", "auditpol.exe", "wevtutil.exe", "reg.exe", "vbc.exe",
)
PORTS = (21, 22, 80, 135, 139, 389, 443, 445, 1433, 3389, 5985, 5986, 8080, 9090)
REGISTRY = {
    "reg_run_keys": ("\\currentversion\\run", "\\currentversion\\runonce"),
    "reg_services": ("\\services\\", "\\system\\currentcontrolset\\services"),
    "reg_audit_policy": ("\\audit\\", "\\auditpol", "\\eventlog"),
    "reg_security": ("\\security\\", "\\sam\\", "\\lsa\\"),
    "reg_image_hijack": ("\\image file execution", "\\ifeo\\"),
    "reg_com_objects": ("\\clsid\\", "\\inprocserver"),
}
EVENT_IDS = (1, 3, 5, 7, 8, 10, 11, 12, 13, 14, 15, 17, 18, 22, 23, 4103, 4104, 4624, 4625, 4688, 4697, 4720, 4732)
EXTENSIONS = ("exe", "dll", "ps1", "bat", "vbs", "js", "hta", "tmp", "dat")


def basename(path: Column) -> Column:
    """Text after the last backslash, then after the last slash."""
    return F.substring_index(F.substring_index(path, "\\", -1), "/", -1)


def feature_inputs(events: DataFrame) -> DataFrame:
    """``events`` (event_id, ts, record, ...) with the few values the features read; the record itself is not needed further."""
    e, r = F.col("event_id"), F.col("record")
    text = lambda *k: F.coalesce(*(r[x] for x in k), F.lit(""))
    create = e.isin(1, 4688)
    src = F.when(e == 10, text("SourceImage")).when(create, text("Image", "NewProcessName"))
    tgt = F.when(e == 10, text("TargetImage")).when(create, text("ParentImage", "ParentProcessName"))
    base = lambda c: F.when(c != "", basename(F.lower(c)))
    file = F.when((e == 11) & r["TargetFilename"].contains("."), F.lower(F.substring_index(r["TargetFilename"], ".", -1)))
    return events.select(
        *[c for c in events.columns if c != "record"], base(src).alias("src_image"), base(tgt).alias("tgt_image"), F.when(e == 7, base(text("ImageLoaded"))).alias("dll"),
        F.when(create, F.length(text("CommandLine"))).alias("cmd_len"), F.when(e.isin(3, 5156), F.nullif(r["DestinationIp"], F.lit(""))).alias("dst_ip"),
        F.when(e.isin(3, 5156), F.trim(r["DestinationPort"]).try_cast("int")).alias("dst_port"), F.when(e.isin(12, 13, 14), F.lower(text("TargetObject"))).alias("reg_target"), file.alias("ext"))


def feature_columns() -> dict[str, Column]:
    """Name to aggregate over :func:`feature_inputs` rows of one session; 103 names, sorted."""
    e = F.col("event_id")
    num = lambda cond: F.coalesce(F.count_if(cond), F.lit(0)).cast("double")
    dist = lambda c: F.count_distinct(c).cast("double")
    dur = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000
    out = {f"proc_{b.removesuffix('.exe')}": (F.count_if(F.col("src_image") == b) + F.count_if(F.col("tgt_image") == b)).cast("double") for b in BINARIES}
    out |= {
        "process_access_count": num(e == 10), "process_create_count": num(e.isin(1, 4688)), "image_load_count": num(e == 7), "lsass_targeted_count": num(F.col("tgt_image") == "lsass.exe"),
        "unique_source_images": dist("src_image"), "unique_target_images": dist("tgt_image"), "unique_dlls_loaded": dist("dll"), "max_command_line_length": F.coalesce(F.max("cmd_len"), F.lit(0)).cast("double"),
        **{f"net_port_{p}": num(F.col("dst_port") == p) for p in PORTS},
        "network_fanout": dist("dst_ip"), "network_flow_count": num(e.isin(3, 5156)), "unique_port_count": dist("dst_port"),
        **{f"eid_{i}_count": num(e == i) for i in EVENT_IDS},
        **{k: num(_any(F.col("reg_target"), pats)) for k, pats in REGISTRY.items()},
        **{f"file_ext_{x}": num(F.col("ext") == x) for x in EXTENSIONS},
        "registry_mod_count": num(e.isin(12, 13, 14)), "file_creation_count": num(e == 11), "unique_event_types": dist("event_id"),
        "failed_login_count": num(e == 4625), "successful_login_count": num(e == 4624), "login_frequency": F.count_if(e.isin(4624, 4625)) / (F.greatest(F.lit(1.0), dur) / 60.0),
        "is_off_hours": F.when((F.hour(F.min("ts")) < 9) | (F.hour(F.min("ts")) >= 17), 1.0).otherwise(0.0), "window_duration": dur.cast("double"),
    }
    return dict(sorted(out.items()))


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    out = c.contains(patterns[0])
    for p in patterns[1:]:
        out |= c.contains(p)
    return out


FEATURES = (
    *sorted(
        [f"proc_{b.removesuffix('.exe')}" for b in BINARIES] + [f"net_port_{p}" for p in PORTS] + [f"eid_{i}_count" for i in EVENT_IDS] + list(REGISTRY) + [f"file_ext_{x}" for x in EXTENSIONS]
        + ["process_access_count", "process_create_count", "image_load_count", "lsass_targeted_count", "unique_source_images", "unique_target_images", "unique_dlls_loaded", "max_command_line_length",
           "network_fanout", "network_flow_count", "unique_port_count", "registry_mod_count", "file_creation_count", "unique_event_types", "failed_login_count", "successful_login_count",
           "login_frequency", "is_off_hours", "window_duration"]),
)


def session_features(inputs: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """One row per ``keys`` with all 103 features and the aggregates ``more``.  Distinct counts are taken in an aggregate of their own.

    Plain counts combine before the shuffle; the five distinct counts go through collect_set, which does too, instead
    of multiplying the rows by the number of distinct columns.
    """
    cols = feature_columns()
    sets = {"unique_source_images": "src_image", "unique_target_images": "tgt_image", "unique_dlls_loaded": "dll", "network_fanout": "dst_ip", "unique_port_count": "dst_port", "unique_event_types": "event_id"}
    aggs = [F.size(F.collect_set(sets[n])).cast("double").alias(n) if n in sets else c.alias(n) for n, c in cols.items()]
    return inputs.groupBy(*keys).agg(*aggs, *(c.alias(n) for n, c in more.items()))


def evidence(lsass: bool = True, access: bool = True, network: bool = True, registry: bool = True, failed: bool = True) -> Column:
    """Whether a feature row holds explicit indicators; the binaries always count, the rest can be switched off."""
    switched = {"lsass_targeted_count": lsass, "process_access_count": access, "network_flow_count": network, "registry_mod_count": registry, "failed_login_count": failed}
    out = F.lit(False)
    for name, on in switched.items():
        if on:
            out |= F.col(name) > 0
    for b in BINARIES:
        out |= F.col(f"proc_{b.removesuffix('.exe')}") > 0
    return out
