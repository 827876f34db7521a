"""Ragged behavioural features of benign corpora: an absent key is not a zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talewind.operators.labels import BENIGN_ONLY

FLOW_COLUMNS = ("Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Flow Bytes/s", "Flow Packets/s")  # fixed values


def assert_benign(source: str) -> None:
    """Raises for a source that is not known to hold benign activity only."""
    if source not in BENIGN_ONLY:
        raise ValueError(f"{source} is not a benign-only source")


def auth_features(lines: DataFrame, source: str = "LANL") -> DataFrame:
    """``(activity_id, features)`` per source computer of authentication lines ``(value)``; lines of fewer than 9 fields are dropped."""
    assert_benign(source)
    p = F.split(F.col("value"), ",", -1)
    rows = lines.filter(F.size(p) >= 9).select(p[3].alias("src"), p[4].alias("dst"), F.lower(p[8]).startswith("fail").alias("failed"))
    g = rows.groupBy("src").agg(F.count("*").cast("double").alias("a"), F.count_if("failed").cast("double").alias("f"), F.count_if(F.col("src") != F.col("dst")).cast("double").alias("r"))
    m = F.map_filter(F.create_map(F.lit("auth_count"), "a", F.lit("auth_fail"), "f", F.lit("remote_auth"), "r"), lambda k, v: v > 0)
    return g.select(F.concat(F.lit("lanl_auth::"), "src").alias("activity_id"), m.alias("features"))


def flow_features(rows: DataFrame, ordinal: str, label: str = "Label", source: str = "CICIDS") -> DataFrame:
    """Benign network flows; header names are trimmed, unreadable numbers are 0, the ordinal counts all rows."""
    assert_benign(source)
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    num = lambda c: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")).try_cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    m = F.create_map(*(x for c in sorted(FLOW_COLUMNS) for x in (F.lit(c), num(c))))
    return rows.filter(F.upper(F.trim(F.col(label))) == "BENIGN").select(F.concat(F.lit("cicids::"), F.col(ordinal).cast("string")).alias("activity_id"), m.alias("features"))


def network_features(rows: DataFrame, ordinal: str, kind: str = "type", exclude: tuple[str, ...] = ("label",), source: str = "TONIOT") -> DataFrame:
    """Normal rows with every column that reads as a number, but for the kind, the ordinal and label columns; rows without any are dropped."""
    assert_benign(source)
    cols = [c for c in rows.columns if c not in (kind, ordinal, *exclude)]
    m = F.map_filter(F.create_map(*(x for c in cols for x in (F.lit(c), F.col(f"`{c}`").cast("string").try_cast("double")))), lambda k, v: v.isNotNull())
    return rows.filter(F.lower(F.trim(F.col(kind))) == "normal").select(F.concat(F.lit("toniot::"), F.col(ordinal).cast("string")).alias("activity_id"), m.alias("features")).filter(F.size("features") > 0)
