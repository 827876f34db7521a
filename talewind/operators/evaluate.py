"""Metrics of probabilistic predictions, leave-one-group-out evaluation and data audits.

Predictions are rows ``(y, pred, proba)`` with ``proba`` an array in the order of ``classes``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def no_leakage(train: DataFrame, test: DataFrame, group: str) -> None:
    """Raises where a group lies on both sides."""
    both = train.select(F.col(group).cast("string")).intersect(test.select(F.col(group).cast("string")))
    if not both.isEmpty():
        raise ValueError(f"group on both sides: {both.first()[0]}")


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("y", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(pred: DataFrame, labels: list[str]) -> DataFrame:
    """One row per label in order, one column per predicted label."""
    order = pred.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, y string")
    wide = pred.groupBy("y").pivot("pred", labels).count().na.fill(0)
    return order.join(wide, "y", "left").na.fill(0).orderBy("i").drop("i")


def macro(pred: DataFrame) -> DataFrame:
    """``(macro_precision, macro_recall, macro_f1)`` over the classes that occur as truth or prediction; 0 where undefined."""
    c = confusion(pred)
    per = (
        c.select(F.col("y").alias("k"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).alias("p"))
        .unionByName(c.select(F.col("pred").alias("k"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.col("n").alias("p")))
        .groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p")))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return per.agg(
        F.avg(safe(F.col("tp"), F.col("p"))).alias("macro_precision"), F.avg(safe(F.col("tp"), F.col("t"))).alias("macro_recall"), F.avg(safe(2 * F.col("tp"), F.col("t") + F.col("p"))).alias("macro_f1"))


def predicted(classes: list[str], proba: str = "proba") -> Column:
    """Class of the largest probability; the first of equals."""
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(F.col(proba), F.array_max(proba)).cast("int"))


def top_k(pred: DataFrame, classes: list[str], k: int = 3) -> DataFrame:
    """``top_k_accuracy``: the truth is among the k likeliest (earlier classes first among equals); unknown truths miss; no rows give 0."""
    ranked = F.array_sort(F.transform("proba", lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    names = F.transform(F.slice(ranked, 1, k), lambda s: F.element_at(F.array(*map(F.lit, classes)), s.i + 1))
    return pred.agg(F.coalesce(F.avg(F.array_contains(names, F.col("y")).cast("double")), F.lit(0.0)).alias("top_k_accuracy"))


def calibration_error(pred: DataFrame, bins: int = 10) -> DataFrame:
    """``ece`` over equal-width bins open at the left; confidence 0 lies in no bin; no rows give 0."""
    conf = F.array_max("proba")
    edges = np.linspace(0.0, 1.0, bins + 1).tolist()
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < conf))  # edges below: 0 for no bin
    b = pred.select(at.alias("bin"), conf.alias("conf"), (F.col("y") == F.col("pred")).cast("double").alias("ok")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("ok").alias("acc"), F.avg("conf").alias("conf"))
    gap = F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return b.agg(F.coalesce(F.sum(gap) / F.sum("n"), F.lit(0.0)).alias("ece"))


def brier(pred: DataFrame, classes: list[str]) -> DataFrame:
    hot = F.transform(F.array(*map(F.lit, classes)), lambda c: F.when(c == F.col("y"), 1.0).otherwise(0.0))
    return pred.agg(F.avg(F.aggregate(F.zip_with("proba", hot, lambda p, h: (p - h) * (p - h)), F.lit(0.0), lambda a, x: a + x)).alias("brier"))


def majority(pred: DataFrame) -> DataFrame:
    """``(label, share)`` of the commonest truth, the smallest label among equals."""
    return pred.groupBy(F.col("y").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).select("label", "n")


def bootstrap(counts: list[tuple[str, str, int]], metric: Callable[[np.ndarray, np.ndarray, np.ndarray], float], reps: int = 1000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float, float]:
    """Point and percentile interval by resampling the confusion counts (classes by classes in size, whatever the rows)."""
    t, p, n = (np.array(x) for x in zip(*counts))
    rng, total = np.random.default_rng(seed), int(n.sum())
    draws = rng.multinomial(total, n / total, size=reps)
    stats = [metric(t, p, d) for d in draws]
    return metric(t, p, n), float(np.percentile(stats, 100 * alpha / 2)), float(np.percentile(stats, 100 * (1 - alpha / 2)))


def macro_f1_of_counts(t: np.ndarray, p: np.ndarray, n: np.ndarray) -> float:
    out = []
    for k in np.union1d(t[n > 0], p[n > 0]):
        tp, a, b = n[(t == k) & (p == k)].sum(), n[t == k].sum(), n[p == k].sum()
        out.append(2 * tp / (a + b) if a + b else 0.0)
    return float(np.mean(out)) if out else 0.0


def group_folds(sizes: list[tuple[str, int]], splits: int = 3) -> dict[str, int]:
    """Group to fold: largest group first, each to the smallest fold so far; folds = max(2, min(splits, groups))."""
    k = max(2, min(splits, len(sizes)))
    load, out = [0] * k, {}
    for g, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        i = load.index(min(load))
        out[g], load[i] = i, load[i] + n
    return out


def dataset_audit(rows: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, max_abs, active)`` of every column, in one pass."""
    m = rows.agg(*(F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in features))
    return m.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("max_abs")) for c in features))).alias("r")).select("r.*").withColumn("active", F.col("max_abs") > 0)


def duplicate_vectors(rows: DataFrame, features: list[str], group: str, label: str) -> DataFrame:
    """Identical feature rows: per content hash with at least two rows its count, groups and labels."""
    h = F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in features)), {"ignoreNullFields": "false"}), 256)
    return rows.groupBy(h.alias("hash")).agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"), F.count_distinct(label).alias("n_labels")).filter("n >= 2")


def evidence_report(rows: DataFrame, label: str, has: Column) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.count_if(has).alias("n_evidence"))


def may_persist(macro_f1: float, baselines: list[float], ece: float) -> bool:
    """Whether a model clears the best baseline by 0.05 and is calibrated within 0.15."""
    return macro_f1 > max(baselines) + 0.05 and ece < 0.15


def _per_class(pred: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, k, tp, t, p)``: hits, truths and predictions of each class that occurs."""
    c = pred.groupBy(*keys, "y", "pred").agg(F.count("*").alias("n"))
    one = lambda k, tp, t, p: c.select(*keys, F.col(k).alias("k"), tp.alias("tp"), t.alias("t"), p.alias("p"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    return one("y", hit, F.col("n"), zero).unionByName(one("pred", zero, zero, F.col("n"))).groupBy(*keys, "k").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))


def fold_metrics(pred: DataFrame, k: int = 3, bins: int = 10) -> DataFrame:
    """One row per held-out group of ``(group, y, pred, proba, classes)``: its size and every metric of its own predictions.

    ``classes`` is the order of ``proba``; the model of a group may lack classes that others have.
    """
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = _per_class(pred, "group").groupBy("group").agg(
        F.avg(safe(F.col("tp"), F.col("p"))).alias("macro_precision"), F.avg(safe(F.col("tp"), F.col("t"))).alias("macro_recall"), F.avg(safe(2 * F.col("tp"), F.col("t") + F.col("p"))).alias("macro_f1"))
    pairs = F.arrays_zip(F.col("proba").alias("p"), F.col("classes").alias("c"))
    ranked = F.array_sort(F.transform(pairs, lambda x, i: F.struct((-x.p).alias("p"), i.alias("i"), x.c.alias("c"))))
    top = F.exists(F.slice(ranked, 1, k), lambda x: x.c == F.col("y"))
    gap = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.pow(x.p - F.when(x.c == F.col("y"), 1.0).otherwise(0.0), F.lit(2.0)))
    edges = F.array(*map(F.lit, np.linspace(0.0, 1.0, bins + 1).tolist()))
    conf = F.array_max("proba")
    rows = pred.select("group", conf.alias("conf"), F.size(F.filter(edges, lambda e: e < conf)).alias("bin"), (F.col("y") == F.col("pred")).cast("double").alias("ok"), top.cast("double").alias("top"), gap.alias("gap"))
    # one pass: everything else is a sum over (group, bin)
    b = rows.groupBy("group", "bin").agg(F.count("*").alias("n"), F.avg("ok").alias("acc"), F.avg("conf").alias("conf"), F.sum("top").alias("top"), F.sum("gap").alias("gap"))
    off = F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    rest = b.groupBy("group").agg(F.sum("n").alias("n_test"), (F.sum("top") / F.sum("n")).alias("top3"), (F.sum(off) / F.sum("n")).alias("ece"), (F.sum("gap") / F.sum("n")).alias("brier"))
    return rest.join(per, "group").select("group", "n_test", "macro_f1", "macro_precision", "macro_recall", "top3", "ece", "brier")


def random_counts(counts: list[tuple[str, str, int]], classes: list[str], seed: int = 0) -> list[tuple[str, str, int]]:
    """Confusion counts of predictions drawn uniformly from ``classes``: one multinomial draw for each true class."""
    rng, truth = np.random.default_rng(seed), {}
    for t, _, n in counts:
        truth[t] = truth.get(t, 0) + n
    return [(t, c, int(m)) for t, n in sorted(truth.items()) for c, m in zip(classes, rng.multinomial(n, [1 / len(classes)] * len(classes)))]


def pooled(pred: DataFrame, folds: DataFrame, reps: int = 1000, seed: int = 0) -> dict[str, float]:
    """Metrics of all predictions together with a bootstrap interval, the means over folds, and both baselines.

    What reaches the driver is one count per pair of classes.  The majority baseline is the commonest truth, the
    smallest among equals; the random one draws uniformly from the true classes.
    """
    counts = [(r.y, r.pred, r.n) for r in pred.groupBy("y", "pred").agg(F.count("*").alias("n")).orderBy("y", "pred").collect()]
    if not counts:
        return {}
    point, lo, hi = bootstrap(counts, macro_f1_of_counts, reps, seed=seed)
    whole = macro(pred).first()
    mean = folds.agg(*(F.avg(c).alias(c) for c in ("macro_f1", "top3", "ece", "brier"))).first()
    n: dict[str, int] = {}
    for t, _, m in counts:
        n[t] = n.get(t, 0) + m
    top = min(n, key=lambda t: (-n[t], t))
    f1 = lambda c: macro_f1_of_counts(*(np.array(x) for x in zip(*c)))
    return {
        "macro_f1": point, "macro_f1_ci_lo": lo, "macro_f1_ci_hi": hi, "macro_precision": whole.macro_precision, "macro_recall": whole.macro_recall,
        "mean_fold_macro_f1": mean.macro_f1, "mean_fold_top3": mean.top3, "mean_fold_ece": mean.ece, "mean_fold_brier": mean.brier,
        "majority_macro_f1": f1([(t, top, m) for t, m in n.items()]), "random_macro_f1": f1(random_counts(counts, sorted(n), seed))}


def supported_targets(rows: DataFrame, target: str, scenario: str, min_scenarios: int = 5) -> DataFrame:
    """The rows whose single technique occurs in at least ``min_scenarios`` scenarios."""
    ok = rows.filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("_t")).agg(F.count_distinct(scenario).alias("_n")).filter(F.col("_n") >= min_scenarios).select("_t")
    return rows.join(ok, F.col(target) == F.col("_t"), "left_semi")


STRATEGIES = ("unfiltered", "evidence", "ueba")  # fixed values, in the order they are judged in


def strategy_audit(rows: DataFrame, target: str, scenario: str, has: Column, score: Column, threshold: float = 0.5) -> DataFrame:
    """Per strategy of keeping rows: samples, coverage in percent, scenarios, classes and whether it can be evaluated.

    ``rows`` hold a target each; a strategy with no rows, or fewer than two scenarios or classes, is skipped.
    """
    keep = dict(zip(STRATEGIES, (F.lit(True), has, score >= threshold)))
    one = F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(s).alias("strategy"), F.coalesce(c, F.lit(False)).alias("kept")) for i, (s, c) in enumerate(keep.items())))).alias("s")
    x = rows.select(target, scenario, one).select("s.*", F.when(F.col("s.kept"), F.col(target)).alias("t"), F.when(F.col("s.kept"), F.col(scenario)).alias("g"))
    a = x.groupBy("position", "strategy").agg(F.count_if("kept").alias("samples"), F.count("*").alias("total"), F.count_distinct("g").alias("scenarios"), F.count_distinct("t").alias("classes"))
    return a.select("position", "strategy", "samples", (100.0 * F.col("samples") / F.col("total")).alias("coverage"), "scenarios", "classes", ((F.col("samples") == 0) | (F.col("scenarios") < 2) | (F.col("classes") < 2)).alias("skipped"))


def target_policy(rows: DataFrame, target: str) -> DataFrame:
    """``(policy, n)``: rows with a single technique, which can be trained on, and rows with several."""
    return rows.groupBy(F.when(F.col(target).isNotNull(), "single").otherwise("several").alias("policy")).agg(F.count("*").alias("n"))


def class_retention(rows: DataFrame, target: str, has: Column) -> DataFrame:
    """Per class: rows, rows with evidence, and their share in percent."""
    return evidence_report(rows, target, has).withColumn("percent", 100.0 * F.col("n_evidence") / F.col("n"))
