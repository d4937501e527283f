"""Session settings, and what workers need to import this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: What a Python worker holds of its input at once; rows of long texts would make batches of any size otherwise.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def build(master: str = "local[8]", **settings: str) -> SparkSession:
    """A session for local use; a cluster brings its own."""
    builder = SparkSession.builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers of this machine find the package, wherever the driver was started, and bound their batches."""
    sc = spark.sparkContext
    have = sc.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        sc.environment["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark
