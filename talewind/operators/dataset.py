"""The labelled dataset: scenarios with labels, their event archives, sessions, features and targets in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talewind.operators import features, labels, parse, sessions
from talewind.sources import files
from talewind.spool import Spool

#: Between a scenario and a host in the key under which sessions are built; hosts hold no control characters.
_SEP = "\x1f"


def scenario_records(spark: SparkSession, scenarios: DataFrame, archives: DataFrame) -> DataFrame:
    """``(scenario_id, seq, record)`` of the archives of labelled scenarios, numbered in the order of scenario, archive, member and line.

    Labels are looked at first: an archive no labelled scenario links to is not opened.  One path per archive reaches
    the driver.  An archive several scenarios link to counts in each.
    """
    labelled = labels.label_sets(files.mappings_of(scenarios)).select("scenario_id")
    wanted = files.resolve_links(scenarios.join(labelled, "scenario_id", "left_semi"), archives).distinct()
    paths = sorted({r.path for r in wanted.select("path").collect()})
    if not paths:
        return spark.createDataFrame([], "scenario_id string, seq long, record map<string,string>")
    lines = files.zipped_lines(spark, paths)
    return files.records(lines.join(wanted, "path"), "scenario_id", "path", "member", "line_no", keep=("scenario_id",)).filter("not bad_json").select("scenario_id", "seq", "record")


def build_dataset(records: DataFrame, mappings: DataFrame, spool: Spool, gap_s: int = 300, source: str = "OTRF") -> tuple[DataFrame, DataFrame]:
    """Dataset and drop counts of ``(scenario_id, seq, record)`` and ``(scenario_id, technique, sub_technique, tactics)``.

    The dataset has one row per session: scenario_id, kind, session, the 103 features, techniques, y_primary,
    train_target (null where a scenario has several techniques) and has_evidence.  Scenarios without a technique or
    without a kept event have no rows; sessions never span scenarios, though they may share hosts.
    """
    label = labels.check_benign(labels.label_sets(mappings), source)
    tagged = records.join(label.select("scenario_id"), "scenario_id", "left_semi")
    parsed = spool.cut(parse.parse(tagged.select("seq", "record", "scenario_id"), "scenario_id"), "parsed")
    events = parse.kept(parsed).withColumn("host", F.concat_ws(_SEP, "scenario_id", "host"))
    members = spool.cut(sessions.build_sessions(events, spool, gap_s), "members")
    rows = features.session_features(features.feature_inputs(events).join(members.select("seq", "kind", "session"), "seq"), "scenario_id", "kind", "session")
    target, primary = labels.targets(F.col("techniques"))
    out = rows.join(label.select("scenario_id", "techniques", target, primary), "scenario_id")
    return out.withColumn("has_evidence", features.evidence()), parse.drop_counts(parsed)
