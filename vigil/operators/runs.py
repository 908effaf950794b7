"""Run-history family: M27, M28."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.base import as_col, latest, packed, to_measures


def latest_run(runs: DataFrame, job: str | Column = "job", started: str | Column = "started",
               run_id: str | Column = "run_id", state: str | Column = "state", life_cycle: str | Column | None = None,
               duration_ms: str | Column | None = None, check: str = "latest_run") -> DataFrame:
    """The newest run per job (start time, then run id). The newest per job and state
    comes first (a hash aggregate, as the states of a job are few), then the newest of a
    job's states; no task sorts or windows the run history."""
    fields = [(F.lit(None) if life_cycle is None else as_col(life_cycle)).cast("string").alias("life_cycle"),
              (F.lit(None) if duration_ms is None else as_col(duration_ms)).cast("double").alias("duration")]
    rows = runs.select(as_col(job).alias("pipeline"), as_col(state).cast("string").alias("state"), *fields,
                       as_col(started).alias("started"), as_col(run_id).alias("run_id"))
    order = packed(rows, "started", "run_id")
    if order is None:  # run ids of another type
        agg = rows.groupBy("pipeline").agg(latest([F.col("started"), F.col("run_id")], F.col("state"), F.col("started"),
                                                  F.col("life_cycle"), F.col("duration")).alias("r"))
    else:
        per_state = rows.groupBy("pipeline", "state", "life_cycle").agg(
            F.max_by("duration", order).alias("duration"), F.max("started").alias("started"), F.max(order).alias("o"))
        agg = per_state.groupBy("pipeline").agg(
            F.max_by(F.struct("state", "started", "life_cycle", "duration"), "o").alias("r"))
    return to_measures(agg, check, state=F.col("r.state"), raw=F.col("r.life_cycle"),
                       value=F.col("r.duration"), observed_at=F.col("r.started"))


def latest_attempt(apps: DataFrame, name: str | Column, started: str | Column, app_id: str | Column,
                   attempts: str | Column, top_n: int = 20, check: str = "latest_attempt") -> DataFrame:
    """Among the newest ``top_n`` applications, the first (newest) of each
    name, then its first attempt's ``completed`` and ``duration``. The top-n is a
    TakeOrderedAndProject: every task keeps its own n newest, one task merges
    n x tasks rows. Names outside the newest n have no row (unknown)."""
    newest = apps.select(as_col(name).alias("pipeline"), as_col(started).alias("started"),
                         as_col(app_id).alias("app_id"), as_col(attempts).alias("attempts")) \
        .orderBy(F.col("started").desc(), F.col("app_id").desc()).limit(top_n)
    agg = newest.groupBy("pipeline").agg(
        latest([F.col("started"), F.col("app_id")],
                 F.try_element_at("attempts", F.lit(1)).alias("a"), F.col("started").alias("started")).alias("x"))
    return to_measures(agg, check, state=F.lower(F.col("x.a.completed").cast("string")),
                       value=F.col("x.a.duration"), observed_at=F.col("x.started"))
