"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers need no shared source folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    here = tempfile.mkdtemp(prefix="talewind-ship-")
    atexit.register(shutil.rmtree, here, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(here, "talewind"), "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; NTZ timestamps become UTC instants once, here."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df
