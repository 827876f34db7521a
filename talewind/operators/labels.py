"""Technique labels of scenarios: multi-label sets, the space of supported labels, training targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BENIGN_ONLY = ("LANL", "CICIDS", "TONIOT")  # fixed values: sources that may carry no label
UNSUPPORTED = "unsupported_class"


def parent(technique: Column) -> Column:
    """``T1552.004`` to ``T1552``."""
    return F.substring_index(technique, ".", 1)


def label_sets(mappings: DataFrame) -> DataFrame:
    """``(scenario_id, techniques, sub_techniques, tactics)`` of ``(scenario_id, technique, sub_technique, tactics)``; empty techniques are skipped."""
    m = mappings.filter("technique is not null and technique <> ''")
    tactic = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tactics", F.array().cast("array<string>"))))))
    sub = F.when(F.coalesce("sub_technique", F.lit("")) != "", F.concat_ws(".", parent(F.col("technique")), "sub_technique"))
    return m.groupBy("scenario_id").agg(F.array_sort(F.collect_set(parent(F.col("technique")))).alias("techniques"), F.array_sort(F.collect_set(sub)).alias("sub_techniques"), tactic.alias("tactics"))


def check_benign(labels: DataFrame, source: str) -> DataFrame:
    """The labels themselves; raises where a benign-only source carries any."""
    if source in BENIGN_ONLY and not labels.filter(F.size("techniques") > 0).isEmpty():
        raise ValueError(f"{source} is a benign source and must carry no labels")
    return labels


def label_space(labels: DataFrame, min_scenarios: int = 3) -> DataFrame:
    """``(technique, n_scenarios, supported)`` from ``(scenario_id, techniques)``."""
    x = labels.select("scenario_id", F.explode("techniques").alias("technique"))
    return x.groupBy("technique").agg(F.count_distinct("scenario_id").alias("n_scenarios")).withColumn("supported", F.col("n_scenarios") >= min_scenarios)


def project(labels: DataFrame, space: DataFrame, *keys: str) -> DataFrame:
    """Per row of ``keys``: its supported techniques, and the mark of unsupported ones where it has any.

    The space is joined, not collected: it grows with the label set only.
    """
    x = labels.select(*keys, F.explode_outer("techniques").alias("technique")).join(space.filter("supported").select("technique", F.lit(True).alias("ok")), "technique", "left")
    kept = F.when(F.col("ok"), F.col("technique")).when(F.col("technique").isNotNull(), F.lit(UNSUPPORTED))
    return x.groupBy(*keys).agg(F.array_sort(F.collect_set(kept)).alias("projected"))


def targets(techniques: Column) -> tuple[Column, Column]:
    """(train_target, y_primary): the technique if it is the only one, else null; that or the alphabetically first."""
    return F.when(F.size(techniques) == 1, techniques[0]).alias("train_target"), F.array_min(techniques).alias("y_primary")
