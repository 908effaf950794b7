"""Run history flattened to (job, run_id, started, state, life_cycle, duration_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.base import as_col
from vigil.sources.records import Records, json_records, split_records


def runs_frame(df: DataFrame, job: str | Column, run_id: str | Column, started: str | Column, state: str | Column,
               life_cycle: str | Column | None = None, duration_ms: str | Column | None = None) -> DataFrame:
    """Any run export as the run schema; nested fields are plain column paths
    (e.g. ``state.result_state``)."""
    return df.select(
        as_col(job).cast("string").alias("job"),
        as_col(run_id).cast("long").alias("run_id"),
        as_col(started).cast("timestamp_ntz").alias("started"),
        as_col(state).cast("string").alias("state"),
        (F.lit(None) if life_cycle is None else as_col(life_cycle)).cast("string").alias("life_cycle"),
        (F.lit(None) if duration_ms is None else as_col(duration_ms)).cast("long").alias("duration_ms"),
    )


def runs_from_json(spark: SparkSession, path: str, schema: str | None = None, **fields) -> Records:
    """Run exports as JSON lines: the runs (``runs_frame``) and, apart, the lines that can't be read."""
    read = json_records(spark, path, schema)
    return Records(runs_frame(read.good, **fields), read.bad)


EVENT_LOG_SCHEMA = ("`Event` STRING, `App Name` STRING, `App ID` STRING, `App Attempt ID` STRING, "
                    "`Timestamp` BIGINT")


def runs_from_event_log(spark: SparkSession, path: str) -> Records:
    """S6 from Spark event logs (JSON lines), single files or rolled folders: one row per application with its
    name, id, start time and attempts, newest attempt first (as a history server lists them; numbers
    order as numbers), each attempt ``(attempt, completed, duration, gap)`` in milliseconds. Bad lines come apart.

    A log is a file, or all ``events_<n>_`` parts of one ``eventlog_v2_`` folder: start and end may
    lie in different parts. ``gap`` marks a log that lacks a part between 1 and its last; its attempt
    is completed only if an end event was found. Events are reduced per log by one aggregate; attempts per
    application are few (bounded by the cluster's maximum), so an array per application is safe."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("_file"))
    read = split_records(lines.where("trim(record) <> '' AND _file NOT LIKE '%/appstatus\\_%'"), EVENT_LOG_SCHEMA)
    folder = F.regexp_extract("_file", r"^(.*/eventlog_v2_[^/]+)/[^/]+$", 1)
    ev = read.good.withColumn("_log", F.when(folder != "", folder).otherwise(F.col("_file"))).withColumn(
        "_part", F.regexp_extract("_file", r"/events_(\d+)_[^/]*$", 1).try_cast("int"))
    start, end = (F.col("Event") == f"SparkListenerApplication{x}" for x in ("Start", "End"))

    def of_start(c):
        return F.max(F.when(start, F.col(c)))
    attempts = ev.groupBy("_log").agg(
        of_start("App ID").alias("app_id"), of_start("App Name").alias("name"), of_start("App Attempt ID").alias("attempt"),
        F.min(F.when(start, F.col("Timestamp"))).alias("start_ms"), F.max(F.when(end, F.col("Timestamp"))).alias("end_ms"),
        F.max("_part").alias("parts"), F.count_distinct("_part").alias("found"))
    attempts = attempts.where("app_id IS NOT NULL").withColumn("attempt", F.coalesce("attempt", F.lit("1")))
    held = F.struct(F.col("attempt").try_cast("int").alias("number"), "attempt", F.col("end_ms").isNotNull().alias("completed"),
                    (F.col("end_ms") - F.col("start_ms")).alias("duration"), F.coalesce(F.col("found") < F.col("parts"), F.lit(False)).alias("gap"))
    per_app = attempts.groupBy("app_id").agg(F.max("name").alias("name"), F.min("start_ms").alias("start_ms"),
                                             F.sort_array(F.collect_list(held), asc=False).alias("attempts"))
    newest_first = F.transform("attempts", lambda a: a.dropFields("number"))
    return Records(per_app.select("name", "app_id", F.timestamp_millis("start_ms").cast("timestamp_ntz").alias("started"),
                                  newest_first.alias("attempts")), read.bad)
