"""What follows an attributed technique: likely next steps and evidence in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talewind.operators import transitions
from talewind.operators.labels import parent


def follow_up(matrix: DataFrame | None, by_technique: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """``(technique, steps, evidence)`` of every distinct technique of ``asked``; nulls are left out.

    ``steps`` are the k likeliest next ones, ``evidence`` says whether a document names the technique or its parent.
    """
    t = asked.filter("technique is not null").select("technique").distinct()
    named = by_technique.select(F.col("technique").alias("_t")).distinct().unionByName(by_technique.select(parent(F.col("technique")).alias("_t"))).distinct()
    found = t.join(named, F.col("technique") == F.col("_t"), "left").select("technique", F.col("_t").isNotNull().alias("evidence"))
    return transitions.predict(matrix, t, k).join(found, "technique")
