"""Technique attribution: hygiene, a balanced random forest, Platt scaling on held-out groups, leave-one-group-out runs."""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from talewind.operators.evaluate import group_folds, may_persist, no_leakage, predicted
from talewind.operators.forest import Forest, fit_forests
from talewind.operators.hygiene import Hygiene
from talewind.spool import Home, Spool

#: Labelled rows a model is fitted on at most; beyond them a random sample is taken.
ROWS = 50_000


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through scores, with smoothed targets."""
    pos, neg = int(y.sum()), int((~y).sum())
    t = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    x = np.stack([score, np.ones_like(score)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -35, 35)))
        g = x.T @ (p - t) + 1e-6 * np.array([a, b])
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 10.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Attribution:
    """``fit`` on ``(features..., label, group)`` rows, then ``predict`` adds ``proba`` (in the order of ``classes``) and ``pred``.

    Nulls and NaN count as 0; rows without a label are no training rows.  Calibration holds groups out in three folds
    (rows, where there are fewer than two groups).  A fold whose training rows lack a class can't predict it; a class
    that one side of a fold lacks is left unscaled there, and ``uncalibrated`` names it.
    """

    features: list[str]
    trees: int = 300
    depth: int = 10
    calibrate: bool = True
    seed: int = 42
    rows: int = ROWS
    version: str = ""
    classes: list[str] = field(default_factory=list)
    hygiene: Hygiene | None = None
    forests: list[Forest] = field(default_factory=list)
    scalers: list[list[tuple[float, float] | None] | None] = field(default_factory=list)
    uncalibrated: list[tuple[int, str]] = field(default_factory=list)

    def fit(self, rows: DataFrame, label: str, group: str | None = None) -> Attribution:
        rows = rows.filter(F.col(label).isNotNull())
        self.hygiene = Hygiene().fit(rows, self.features)  # on training rows only
        spark, kept = rows.sparkSession, self.hygiene.kept
        sample = rows.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(kept)), F.col(label).cast("string").alias("y"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"))
        pdf = sample.orderBy(F.rand(self.seed)).limit(self.rows).toPandas()  # the documented bound
        pdf = pdf.sort_values(["g", "y", *[f"x{i}" for i in range(min(3, len(kept)))]], kind="stable", ignore_index=True)
        x = np.nan_to_num(pdf[[f"x{i}" for i in range(len(kept))]].to_numpy(float))
        self.classes = sorted(pdf["y"].unique())
        y = np.searchsorted(np.array(self.classes, object), pdf["y"].to_numpy(object)).astype(np.int64) if len(pdf) else np.empty(0, np.int64)
        k, every = len(self.classes), np.arange(len(y))
        if not self.calibrate or len(y) < 3:
            self.forests, self.scalers = fit_forests(spark, x, y, k, [every], self.trees, self.depth, self.seed), [None]
            return self
        sizes = [(g, int(n)) for g, n in pdf["g"].value_counts().items()]
        if len(sizes) >= 2:
            of = group_folds(sizes, 3)
            fold = pdf["g"].map(of).fillna(0).to_numpy(int)
        else:
            fold = np.random.default_rng(self.seed).permutation(len(y)) % 3
        folds = sorted(set(fold.tolist()))
        self.forests = fit_forests(spark, x, y, k, [every[fold != i] for i in folds], self.trees, self.depth, self.seed)
        for i, forest in zip(folds, self.forests):
            held = fold == i
            p = forest.predict(x[held])
            scale: list[tuple[float, float] | None] = []
            for c in range(k):
                is_c = y[held] == c
                there = is_c.any() and not is_c.all() and (y[~held] == c).any()
                scale.append(platt(p[:, c], is_c) if there else None)
                if not there:
                    self.uncalibrated.append((i, self.classes[c]))
            self.scalers.append(scale)
        return self

    def _proba(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)))
        for forest, scale in zip(self.forests, self.scalers):
            p = forest.predict(x)
            for c, s in enumerate(scale or []):
                if s is not None:
                    p[:, c] = 1 / (1 + np.exp(-np.clip(s[0] * p[:, c] + s[1], -35, 35)))
            total = p.sum(1, keepdims=True)
            out += np.where(total > 0, p / np.where(total > 0, total, 1), 1 / max(1, len(self.classes)))
        return out / max(1, len(self.forests))

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.hygiene is None:
            raise RuntimeError("fit before predict")
        kept, spark = self.hygiene.kept, rows.sparkSession
        held = spark.sparkContext.broadcast(self)  # trees of at most 2 ** depth leaves
        at = F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in kept)).cast("array<double>")

        def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = held.value
            for s in frames:
                x = np.stack(s.to_numpy()) if len(s) else np.empty((0, len(kept)))
                yield pd.Series(list(model._proba(x.astype(float))))

        return rows.withColumn("proba", _iterator_udf(run)(at)).withColumn("pred", predicted(self.classes))

    def save(self, home: Home, name: str) -> str:
        """Write the artifact as one text below ``home``; a name is written once."""
        body = {f: getattr(self, f) for f in ("features", "trees", "depth", "calibrate", "seed", "rows", "classes", "scalers", "uncalibrated")}
        trees = base64.b64encode(pickle.dumps(self.forests)).decode("ascii")
        home.commit_text(name, json.dumps({**body, "version": self.version or name, "hygiene": asdict(self.hygiene), "forests": trees}))
        return home.path(name)

    @classmethod
    def load(cls, home: Home, name: str) -> Attribution | None:
        """The artifact, or null where there is none (serving then says ``model_unavailable``).

        The trees are unpickled, so only artifacts of this package's own :meth:`save` may be loaded.
        """
        if name not in home.names():
            return None
        d = json.loads(home.read_text(name))
        scalers = [s and [x and tuple(x) for x in s] for s in d.pop("scalers")]
        missing = [tuple(x) for x in d.pop("uncalibrated")]
        return cls(**{**d, "hygiene": Hygiene(**d["hygiene"]), "forests": pickle.loads(base64.b64decode(d["forests"])), "scalers": scalers, "uncalibrated": missing})


def _iterator_udf(run):
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(frames)

    score.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, ArrayType(DoubleType()))


def save_if_good(model: Attribution, home: Home, name: str, macro_f1: float, baselines: list[float], ece: float) -> str | None:
    """The path of the saved candidate, or null where the gate holds it back."""
    return model.save(home, name) if may_persist(macro_f1, baselines, ece) else None


def serve(model: Attribution | None, rows: DataFrame, k: int = 3) -> DataFrame:
    """``rows`` with ``status``, ``technique``, ``confidence`` and the k likeliest; ``model_unavailable`` and nulls without a model."""
    top = "array<struct<probability:double,technique:string>>"
    if model is None:
        return rows.withColumns({"status": F.lit("model_unavailable"), "technique": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "top": F.lit(None).cast(top)})
    p = model.predict(rows)
    ranked = F.slice(F.sort_array(F.zip_with("proba", F.array(*map(F.lit, model.classes)), lambda a, b: F.struct(a.alias("probability"), b.alias("technique"))), False), 1, k)
    return p.withColumns({"status": F.lit("ok"), "technique": F.col("pred"), "confidence": F.array_max("proba"), "top": ranked})


def leave_one_group_out(rows: DataFrame, features: list[str], label: str, group: str, **model) -> DataFrame:
    """``(group, y, pred, proba, classes)`` of every row with a label, predicted by a model that never saw its group.

    Rows without a group are in no fold.  A group whose other rows have fewer than two classes is left out.  Each
    group's predictions are written out, so that only one group's forests are held at a time.
    """
    sp = Spool(rows.sparkSession, "loso")
    rows = sp.cut(rows.filter(F.col(label).isNotNull() & F.col(group).isNotNull()), "rows")
    out = rows.sparkSession.createDataFrame([], "group string, y string, pred string, proba array<double>, classes array<string>")
    for r in rows.select(F.col(group).cast("string").alias("g")).distinct().orderBy("g").collect():  # one entry per held-out group
        test, train = rows.filter(F.col(group).cast("string") == r.g), rows.filter(F.col(group).cast("string") != r.g)
        no_leakage(train, test, group)
        if train.select(label).distinct().limit(2).count() < 2:
            continue
        m = Attribution(features, **model).fit(train, label, group)
        out = out.unionByName(sp.cut(m.predict(test).select(F.col(group).cast("string").alias("group"), F.col(label).cast("string").alias("y"), "pred", "proba", F.array(*map(F.lit, m.classes)).alias("classes")), "predicted"))
    return out
