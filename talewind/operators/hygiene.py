"""Feature hygiene fitted on training rows only: artefact names, constant columns, correlated columns."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

ARTEFACTS = ("vmware", "virtualbox", "vbox", "theshire", "mordordc", "capture", "harness", "vagrant", "packer")  # fixed values
LIMIT = 0.98


@dataclass
class Hygiene:
    """Kept and dropped columns; ``fit`` before ``transform``."""

    kept: list[str] | None = None
    artefacts: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)
    correlated: list[str] = field(default_factory=list)

    def fit(self, rows: DataFrame, columns: list[str], limit: float = LIMIT) -> Hygiene:
        """One pass for spreads and one for all correlations of what is left; only column statistics reach the driver."""
        self.artefacts = [c for c in columns if any(a in c.lower() for a in ARTEFACTS)]
        left = [c for c in columns if c not in self.artefacts]
        spread = rows.agg(*(F.min(c).alias(f"a{i}") for i, c in enumerate(left)), *(F.max(c).alias(f"b{i}") for i, c in enumerate(left))).first()
        self.constant = [c for i, c in enumerate(left) if spread[f"a{i}"] == spread[f"b{i}"]]
        left = [c for c in left if c not in self.constant]
        rho = correlations(rows, left)
        self.kept, self.correlated = [], []
        for i, c in enumerate(left):
            near = any(abs(rho[i, left.index(k)]) >= limit for k in self.kept)
            (self.correlated if near else self.kept).append(c)
        return self

    def transform(self, rows: DataFrame, *keep: str) -> DataFrame:
        if self.kept is None:
            raise RuntimeError("fit before transform")
        return rows.select(*keep, *self.kept)

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Hygiene:
        return cls(**json.loads(text))


def correlations(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson matrix; undefined ones are 0.  Nulls and NaN count as 0, as in training.  Columns-by-columns in size."""
    if len(columns) < 2 or rows.isEmpty():
        return np.eye(len(columns))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    v = VectorAssembler(inputCols=columns, outputCol="v").transform(rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.fill(0.0)).select("v")
    return np.nan_to_num(Correlation.corr(v, "v").first()[0].toArray())
