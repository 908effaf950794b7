"""Fixed per-pipeline statuses (the stand-in source for wiring and tests)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.base import as_col, latest, to_measures


def static_status(overrides: DataFrame, key: str | Column = "pipeline", status: str | Column = "status",
                  message: str | Column = "message", last_run: str | Column = "last_run",
                  check: str = "static_status") -> DataFrame:
    """Override rows (pipeline, status word, message, last_run). Pipelines without
    an override get the spec's ``params['default_status']`` (default ok) and the
    message ``Static check for <pipeline>``; unknown words read as unknown."""
    lr = as_col(last_run).cast("timestamp_ntz")
    agg = overrides.groupBy(as_col(key).alias("pipeline")).agg(
        latest([F.coalesce(lr, F.lit("1970-01-01").cast("timestamp_ntz")), as_col(status)],
               as_col(status).cast("string").alias("s"), as_col(message).cast("string").alias("m"),
               lr.alias("t")).alias("o"))
    return to_measures(agg, check, state=F.col("o.s"), raw=F.col("o.m"), observed_at=F.col("o.t"))
