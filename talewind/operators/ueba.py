"""Behavioural anomaly scores: each row against the running statistics of its entity's earlier rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

THRESHOLD, CAP, SCALE, NEUTRAL = 0.5, 10.0, 6.0, 0.5  # fixed values
RETRAIN_EVERY, LEAST, MOST = 500, 50, 5000


def zscores(rows: DataFrame, entity: str, order: list[str], features: list[str], bucket: str | None = None) -> DataFrame:
    """``rows`` with ``z_<feature>``: z of the value against the entity's earlier rows (sample deviation; 0 for fewer than two or no spread).

    With ``bucket`` (a column that grows with the order, such as the day) the sums of whole earlier buckets come from an
    aggregate, so an entity of any size is spread over its buckets.  Values are taken relative to the feature's mean,
    which keeps the sums of squares exact enough.  Null values count as 0.
    """
    means = rows.agg(*(F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in features)).first()
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(float(means[f] or 0.0)) for f in features}
    rows = rows.withColumns({f"_x_{f}": c for f, c in x.items()})
    keys = [entity] + ([bucket] if bucket else [])
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"_n": F.count(F.lit(1)).over(w)} | {f"_s_{f}": F.coalesce(F.sum(f"_x_{f}").over(w), F.lit(0.0)) for f in features} | {f"_q_{f}": F.coalesce(F.sum(F.col(f"_x_{f}") * F.col(f"_x_{f}")).over(w), F.lit(0.0)) for f in features})
    if bucket:
        sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"_x_{f}").alias(f"s_{f}") for f in features), *(F.sum(F.col(f"_x_{f}") * F.col(f"_x_{f}")).alias(f"q_{f}") for f in features))
        b = Window.partitionBy(entity).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(*keys, *(F.coalesce(F.sum(c).over(b), F.lit(0)).alias(f"b_{c}") for c in ["n", *(f"{p}_{f}" for f in features for p in "sq")]))
        out = out.join(before, keys).withColumns({"_n": F.col("_n") + F.col("b_n")} | {f"_{p}_{f}": F.col(f"_{p}_{f}") + F.col(f"b_{p}_{f}") for f in features for p in "sq"})
    z = {}
    for f in features:
        mean = F.col(f"_s_{f}") / F.col("_n")
        var = (F.col(f"_q_{f}") - F.col(f"_s_{f}") * mean) / (F.col("_n") - 1)
        z[f"z_{f}"] = F.when((F.col("_n") >= 2) & (var > 1e-12 * (F.col(f"_q_{f}") / F.col("_n")) + 1e-300), (F.col(f"_x_{f}") - mean) / F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)
    return out.withColumns(z).select(*[c for c in rows.columns if not c.startswith("_x_")], *z)


def scores(scored: DataFrame, features: list[str], forest: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``stat_score``, ``score`` (4 digits), ``is_anomalous`` (on the unrounded score) and the first five ``contributing`` features.

    ``forest`` names a column with the isolation score; without one it is the neutral value of an untrained forest.
    """
    za = {f: F.least(F.abs(f"z_{f}"), F.lit(CAP)) for f in features}
    total = sum(za.values(), F.lit(0.0))
    stat = F.least(F.lit(1.0), total / len(features) / SCALE)
    raw = 0.6 * stat + 0.4 * (F.col(forest) if forest else F.lit(NEUTRAL))
    named = F.array(*(F.when(c > 1.0, F.lit(f)) for f, c in za.items()))
    return scored.withColumns({"stat_score": stat, "score": F.round(raw, 4), "is_anomalous": raw >= threshold, "contributing": F.slice(F.filter(named, lambda v: v.isNotNull()), 1, 5)})


class IsolationForest:
    """Isolation forest over numpy rows: random splits, path length to isolation, score in (-1, 0)."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 42):
        self.trees, self.sample, self.rng, self.forest, self.norm = trees, sample, np.random.default_rng(seed), [], 1.0

    @staticmethod
    def _expected(n: np.ndarray | float) -> np.ndarray | float:
        n = np.maximum(np.asarray(n, float), 1.0)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))

    def fit(self, x: np.ndarray) -> IsolationForest:
        size = min(self.sample, len(x))
        depth = int(np.ceil(np.log2(max(size, 2))))
        self.norm = float(self._expected(size)) or 1.0
        for _ in range(self.trees):
            self.forest.append(self._grow(x[self.rng.choice(len(x), size, replace=False)], depth))
        return self

    def _grow(self, x: np.ndarray, depth: int):
        lo, hi = x.min(0), x.max(0)
        open_ = np.flatnonzero(hi > lo)
        if depth == 0 or len(x) <= 1 or not len(open_):
            return float(self._expected(len(x)))
        f = int(self.rng.choice(open_))
        cut = float(self.rng.uniform(lo[f], hi[f]))
        left = x[:, f] < cut
        return f, cut, self._grow(x[left], depth - 1), self._grow(x[~left], depth - 1)

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))

        def walk(node, at: np.ndarray, depth: int) -> None:
            if not len(at):
                return
            if isinstance(node, float):
                total[at] += depth + node
                return
            f, cut, left, right = node
            go = x[at, f] < cut
            walk(left, at[go], depth + 1)
            walk(right, at[~go], depth + 1)

        for tree in self.forest:
            walk(tree, np.arange(len(x)), 0)
        return -np.exp2(-total / max(1, len(self.forest)) / self.norm)


def with_forest(scored: DataFrame, features: list[str], train: DataFrame, order: list[str], limit: int = MOST, seed: int = 42) -> DataFrame:
    """``scored`` with ``if_score`` of a forest trained on the last ``limit`` non-anomalous rows of ``train`` by ``order``.

    The batch form of :func:`serial_scores`: ``train`` are the rows of earlier batches, and a batch is scored in
    parallel by the forest they gave.  Fewer than 50 training rows leave the neutral score.
    """
    last = train.filter("not is_anomalous").orderBy(*map(F.desc, order)).limit(limit)
    x = np.array([[float(r[f] or 0) for f in features] for r in last.select(*features).collect()])
    if len(x) < LEAST:
        return scored.withColumn("if_score", F.lit(NEUTRAL))
    forest = IsolationForest(seed=seed).fit(x)
    schema = scored.withColumn("if_score", F.lit(0.0)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, frames):
            raw = forest.score_samples(pdf[features].fillna(0).to_numpy(float))
            yield pdf.assign(if_score=1.0 / (1.0 + np.exp(5.0 * raw)))

    return scored.mapInPandas(run, schema)


def serial_scores(scored: DataFrame, features: list[str], order: list[str], stream: str | None = None, threshold: float = THRESHOLD, every: int = RETRAIN_EVERY, seed: int = 42) -> DataFrame:
    """``scored`` (:func:`scores` without a forest) with ``if_score``, and score and is_anomalous by the forest of that moment.

    Rows of one ``stream`` are taken in ``order``.  After every ``every``-th row, if that row is not anomalous and at
    least 50 such rows have been seen, the forest is trained anew on the last 5,000 of them.  A row's score depends on
    all rows before it, so a stream is walked by one task, in blocks and in constant memory; streams (sites, tenants)
    are walked side by side.  Use :func:`with_forest` where one stream is too much for a task.
    """
    spark = scored.sparkSession
    rows = scored.withColumn("_s", F.coalesce(F.col(stream).cast("string"), F.lit("")) if stream else F.lit(""))
    out = scored.withColumns({"if_score": F.lit(0.0), "score": F.lit(0.0), "is_anomalous": F.lit(False)}).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen, held, forest = None, 0, [], None
        for pdf in filter(len, frames):
            start, names = 0, pdf["_s"].tolist()
            x, stat = pdf[features].fillna(0).to_numpy(float), pdf["stat_score"].to_numpy()
            if_score, raw = np.empty(len(pdf)), np.empty(len(pdf))
            while start < len(pdf):
                if names[start] != now:
                    now, seen, held, forest = names[start], 0, [], None
                end = start
                while end < len(pdf) and names[end] == now and end - start < every - seen % every:
                    end += 1
                part = slice(start, end)
                if_score[part] = NEUTRAL if forest is None else 1.0 / (1.0 + np.exp(5.0 * forest.score_samples(x[part])))
                raw[part] = 0.6 * stat[part] + 0.4 * if_score[part]
                normal = raw[part] < threshold
                held = (held + list(x[part][normal]))[-MOST:]
                seen += end - start
                if seen % every == 0 and normal[-1] and len(held) >= LEAST:
                    forest = IsolationForest(seed=seed).fit(np.array(held))
                start = end
            yield pdf.drop(columns="_s").assign(if_score=if_score, score=np.round(raw, 4), is_anomalous=raw >= threshold)[out.names]

    return rows.repartition(spark.sparkContext.defaultParallelism, "_s").sortWithinPartitions("_s", *order).mapInPandas(run, out)


def trainer_scores(rows: DataFrame, order: list[str], bucket: str) -> DataFrame:
    """Scores as a trainer takes them: every row one event of a single entity; features are those of :data:`TRAINER`."""
    one = rows.withColumns({"audit_entity": F.lit("audit_host"), "event_count": F.lit(1.0), **{k: F.col(v).cast("double") for k, v in TRAINER.items()}})
    names = ["event_count", *TRAINER]
    return scores(zscores(one, "audit_entity", order, names, bucket), names)


# The trainer's names of the features it scores by.
TRAINER = {"process_access": "process_access_count", "registry_mod": "registry_mod_count", "failed_login": "failed_login_count", "network_flow": "network_flow_count"}
