"""V14 at run time: a source that fails while it is read makes only its own pipelines unknown.

``guarded`` sees errors of planning. A corrupt file or a failing cast shows when tasks run, and in one
job it would end the results of all checks. Here each check's measures, one small row per
pipeline, are written by a job of their own from a pool of threads, so that one failure leaves the others alone,
and a check whose job fails gets ``SOURCE_ERROR`` rows instead. Later steps read the written rows:
sources are scanned once and a lost executor repeats only its check's job.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.base import to_measures
from vigil.schema import MEASURES, SOURCE_ERROR
from vigil.session import scratch_path


def failed(specs: DataFrame, check: str) -> DataFrame:
    """``SOURCE_ERROR`` rows for the check's pipelines."""
    return to_measures(specs.where(F.col("check") == F.lit(check)).select("pipeline").distinct(), check, state=F.lit(SOURCE_ERROR))


def isolated(specs: DataFrame, builds: Mapping[str, Callable[[], DataFrame]], jobs: int = 4) -> DataFrame:
    """The measures of all checks, ``builds[check]()`` each run by itself, ``jobs`` at a time. ``specs``
    names the pipelines of a check that fails. The same source error gives one log line per check."""
    spark = specs.sparkSession

    def run(check: str) -> DataFrame:
        try:
            path = scratch_path(spark, f"measures-{check}")
            builds[check]().select(*MEASURES.fieldNames()).write.parquet(path)
            return spark.read.schema(MEASURES).parquet(path)
        except Exception as exc:  # noqa: BLE001 - any error of this source, at planning or while it is read
            logging.getLogger("vigil").warning("check %s: source failed: %s", check, str(exc).splitlines()[0][:500])
            return failed(specs, check)
    if not builds:
        return spark.createDataFrame([], MEASURES)
    with ThreadPoolExecutor(max_workers=max(1, min(jobs, len(builds)))) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(run, builds)))
