"""Next-step transition matrices from ordered sequences of techniques."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window, functions as F

from talewind.operators.labels import parent


def sequences(steps: DataFrame) -> DataFrame:
    """``(scenario_id, pos, technique)``: parent techniques in order, empties skipped first, then consecutive repeats."""
    w = Window.partitionBy("scenario_id").orderBy("pos")
    s = steps.filter("technique is not null and technique <> ''").select("scenario_id", "pos", parent(F.col("technique")).alias("technique"))
    return s.withColumn("before", F.lag("technique").over(w)).filter("before is null or before <> technique").drop("before")


def multistage(seq: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Sequences of at least two steps that are compound, of a known multi-day exercise by title, or have at least three."""
    n = seq.groupBy("scenario_id").agg(F.count("*").alias("len"))
    if meta is not None:
        n = n.join(meta.select("scenario_id", F.lower("type").alias("type"), F.lower("title").alias("title")), "scenario_id", "left")
        known = F.coalesce(F.col("type") == "compound", F.lit(False)) | F.coalesce(F.col("title").contains("apt29") | F.col("title").contains("evals"), F.lit(False))
    else:
        known = F.lit(False)
    return seq.join(n.filter((F.col("len") >= 2) & (known | (F.col("len") >= 3))).select("scenario_id"), "scenario_id", "left_semi")


def matrix(seq: DataFrame) -> DataFrame:
    """``(src, dst, support, prob, first_pos)``: counts of neighbours and their share of all steps from ``src``."""
    w = Window.partitionBy("scenario_id").orderBy("pos")
    pairs = seq.withColumn("dst", F.lead("technique").over(w)).filter("dst is not null")
    c = pairs.groupBy(F.col("technique").alias("src"), "dst").agg(F.count("*").alias("support"), F.min(F.struct("scenario_id", "pos")).alias("first_seen"))
    return c.withColumn("prob", F.col("support") / F.sum("support").over(Window.partitionBy("src")))


def next_steps(m: DataFrame, k: int = 3) -> DataFrame:
    """The k likeliest steps after each technique; the one met first wins among equals."""
    w = Window.partitionBy("src").orderBy(F.desc("prob"), "first_seen")
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("src", "dst", "rank", F.round("prob", 4).alias("prob"), "support")


def predict(m: DataFrame | None, asked: DataFrame, k: int = 3) -> DataFrame:
    """``(technique, steps)``: sub-techniques are looked up by their parent; unseen ones and an absent matrix give an empty list."""
    empty = F.array().cast("array<struct<technique:string,probability:double,support:bigint>>")
    if m is None:
        return asked.select("technique", empty.alias("steps"))
    best = next_steps(m, k).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("dst").alias("technique"), F.col("prob").alias("probability"), "support"))), lambda s: F.struct(s.technique.alias("technique"), s.probability.alias("probability"), s.support.alias("support"))).alias("steps"))
    return asked.join(best, parent(F.col("technique")) == F.col("src"), "left").select("technique", F.coalesce("steps", empty).alias("steps"))


def to_json(m: DataFrame, n_scenarios: int) -> str:
    """The matrix as one JSON document; techniques by techniques in size."""
    out: dict = {"matrix": {}, "support": {}, "n_scenarios": n_scenarios, "n_transitions": 0}
    for r in m.orderBy("src", "first_seen").toLocalIterator():
        out["matrix"].setdefault(r.src, {})[r.dst] = r.prob
        out["support"].setdefault(r.src, {})[r.dst] = r.support
        out["n_transitions"] += r.support
    return json.dumps(out)


def from_json(spark, text: str) -> DataFrame:
    """``(src, dst, support, prob, first_seen)``; missing supports are null."""
    d = json.loads(text)
    rows = [(a, b, d.get("support", {}).get(a, {}).get(b), p, (a, i)) for a, row in d["matrix"].items() for i, (b, p) in enumerate(row.items())]
    return spark.createDataFrame(rows, "src string, dst string, support bigint, prob double, first_seen struct<scenario_id:string,pos:bigint>")
