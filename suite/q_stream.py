"""Structured Streaming queries: S9, R1-R3 (availableNow over the events file)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from suite.common import EVENTS_AS_OF, EVENTS_AS_OF_SQL, out, table
from suite.q_lag import TYPES
from suite.q_probes import SERVICES_SQL, service_specs
from suite.registry import ORACLES, query
from suite.sqlkit import num
from vigil import operators as M
from vigil.functions.verdicts import verdict_gt
from vigil.plans.evaluate import as_of_lit
from vigil.operators.base import to_measures
from vigil.plans.specs import normalize_specs, specs_frame
from vigil.session import scratch_path, use_utc
from vigil.plans.evaluate import evaluate
from vigil.streaming import (StateLog, alert_batches, evaluate_batches, file_stream, newest_per_key, partition_progress,
                             late_event_measures, late_events, run_available, watermark_of, window_counts)


def events_stream(spark, sf):
    use_utc(spark)
    schema = table(spark, sf, "events").schema
    return file_stream(spark, f"{sf.rstrip('/')}/events*.parquet", schema)


# ---------------------------------------------------------------- S9 file stream source
@query("s09_file_stream", sql="SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s09_file_stream(spark, sf):
    path = scratch_path(spark, "s09-out")
    writer = events_stream(spark, sf).writeStream.format("parquet").option("path", path).outputMode("append")
    run_available(writer, spark, "s09")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- R1 windowed counts with watermark
@query("r01_stream_window_counts", sql="""
WITH w AS (SELECT event_type AS pipeline, date_trunc('day', ts) AS ws, count(*) AS n FROM events GROUP BY 1, 2)
SELECT pipeline, strftime(ws, '%Y-%m-%d') AS window_start, n,
       CASE WHEN n > 65 THEN 'ok' ELSE 'critical' END AS status
FROM w WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""")
def r01_stream_window_counts(spark, sf):
    path = scratch_path(spark, "r01-out")
    counts = window_counts(events_stream(spark, sf), "event_type", "ts", window="1 day", watermark="10 minutes")
    writer = counts.writeStream.format("parquet").option("path", path).outputMode("append")
    run_available(writer, spark, "r01")
    w = spark.read.parquet(path)
    return w.select("pipeline", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n",
                    verdict_gt(F.col("n").cast("double"), F.lit(65.0)).alias("status"))


# ---------------------------------------------------------------- R1: messages the watermark dropped
LATE_WINDOWS_SQL = """
e AS (SELECT event_type AS pipeline, date_trunc('day', ts) AS ws, ts, coalesce(value < 20, FALSE) AS second FROM events),
marks AS (SELECT max(ts) FILTER (WHERE NOT second) - INTERVAL 10 MINUTE AS first_run, max(ts) - INTERVAL 10 MINUTE AS both_runs FROM e),
late AS (SELECT pipeline, ws, count(*) FILTER (WHERE second AND ws + INTERVAL 1 DAY <= first_run) AS n_late, count(*) AS n_all
         FROM e, marks WHERE ws + INTERVAL 1 DAY <= both_runs GROUP BY 1, 2)"""


def late_windows(spark, sf):
    """Two runs of one stream: the events of small value come with the second, mostly behind the first one's watermark."""
    use_utc(spark)
    events = table(spark, sf, "events")
    folder, path, ckpt = (scratch_path(spark, f"r01-late-{x}") for x in ("in", "out", "state"))
    second = F.coalesce(F.col("value") < 20, F.lit(False))
    for part in (events.where(~second), events.where(second)):
        part.write.mode("append").parquet(folder)
        counts = window_counts(file_stream(spark, folder, events.schema), "event_type", "ts")
        query_ = run_available(counts.writeStream.format("parquet").option("path", path).outputMode("append"), spark, "r01-late", ckpt)
    return late_events(events, spark.read.parquet(path), watermark_of(query_), "event_type", "ts")


@query("r01_late_windows", sql=f"""
WITH {LATE_WINDOWS_SQL}
SELECT pipeline, strftime(ws, '%Y-%m-%d') AS window_start, n_all - n_late AS n, n_late FROM late
""")
def r01_late_windows(spark, sf):
    late = late_windows(spark, sf)
    return late.select("pipeline", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n", "n_late")


@query("r01_late_events", sql=f"""
WITH {LATE_WINDOWS_SQL},
m AS (SELECT pipeline, CAST(sum(n_late) AS DOUBLE) AS value FROM late GROUP BY 1)
SELECT pipeline, value, CASE WHEN value <= 150 THEN 'ok' ELSE 'critical' END AS status FROM m
""")
def r01_late_events(spark, sf):
    specs = specs_frame(spark, [{"pipeline": t, "check": "late_events", "op": "le", "threshold": 150.0} for t in TYPES])
    results = evaluate(specs, late_event_measures(late_windows(spark, sf)), as_of=EVENTS_AS_OF)
    return results.where("value is not null").select("pipeline", "value", "status")


# ---------------------------------------------------------------- R2 running lag per partition
@query("r02_stream_lag", sql=ORACLES["m16_total_lag"])
def r02_stream_lag(spark, sf):
    path = scratch_path(spark, "r02-out")
    cutoff = as_of_lit(EVENTS_AS_OF - dt.timedelta(days=1))
    progress = partition_progress(events_stream(spark, sf), "event_type", "user_id", F.col("ts") < cutoff)
    specs = specs_frame(spark, [{"pipeline": t, "check": "total_lag", "threshold": 65, "params": {"profile": "kafka"}}
                                for t in TYPES])
    sink = evaluate_batches(specs, lambda b: M.total_lag(b), path, lambda b: as_of_lit(EVENTS_AS_OF))
    run_available(progress.writeStream.outputMode("complete").foreachBatch(sink), spark, "r02")
    return out(spark.read.parquet(path))


# ---------------------------------------------------------------- R3 freshness per key
@query("r03_stream_freshness", sql=f"""
WITH m AS (SELECT 'svc-' || CAST(user_id AS VARCHAR) AS pipeline,
                  date_diff('microsecond', max(ts), {EVENTS_AS_OF_SQL}) / 3.6e9 AS v FROM events GROUP BY 1),
j AS (SELECT s.pipeline, m.v FROM {SERVICES_SQL} s LEFT JOIN m USING (pipeline))
SELECT pipeline, 'age_hours' AS "check",
       CASE WHEN v IS NULL THEN 'unknown' WHEN v <= 24 THEN 'ok' ELSE 'critical' END AS status, v AS value,
       24.0 AS threshold,
       CASE WHEN v IS NULL THEN 'age_hours: no data'
            WHEN v <= 24 THEN 'age_hours ' || {num('v')} || 'h old, within 24h'
            ELSE 'age_hours ' || {num('v')} || 'h old, exceeds 24h' END AS message
FROM j
""")
def r03_stream_freshness(spark, sf):
    path = scratch_path(spark, "r03-out")
    key = F.concat(F.lit("svc-"), F.col("user_id").cast("string"))
    newest = newest_per_key(events_stream(spark, sf), key, "ts")
    specs = service_specs(spark, sf, "age_hours")
    as_of = as_of_lit(EVENTS_AS_OF)
    sink = evaluate_batches(specs, lambda b: M.age_hours(b, "pipeline", "newest", as_of), path, lambda b: as_of)
    run_available(newest.writeStream.outputMode("complete").foreachBatch(sink), spark, "r03")
    return out(spark.read.parquet(path))


# ---------------------------------------------------------------- R1 + S10: closed windows -> verdict -> outbox, per batch
@query("r01_stream_window_alerts", sql="""
WITH w AS (SELECT event_type AS t, date_trunc('day', ts) AS ws, count(*) AS n FROM events GROUP BY 1, 2)
SELECT 'log' AS channel, t || '@' || strftime(ws, '%Y-%m-%d') AS pipeline, 'critical' AS status,
       'messages_in_window ' || CAST(n AS VARCHAR) || ' not above threshold 65' AS message
FROM w WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AND n <= 65
""")
def r01_stream_window_alerts(spark, sf):
    path = scratch_path(spark, "r01-alerts")
    counts = window_counts(events_stream(spark, sf), "event_type", "ts", window="1 day", watermark="10 minutes")
    key = F.concat("pipeline", F.lit("@"), F.date_format("window_start", "yyyy-MM-dd"))

    def specs_of(batch):
        return batch.select(key.alias("pipeline"), F.lit("messages_in_window").alias("check"),
                            F.lit("gt").alias("op"), F.lit(65.0).alias("threshold")).transform(normalize_specs)

    def measures_of(batch):
        return to_measures(batch, "messages_in_window", pipeline=key, value=F.col("n"), observed_at=F.col("window_end"))

    sink = alert_batches(specs_of, measures_of, [{"type": "log"}], path, lambda b: as_of_lit(EVENTS_AS_OF))
    run_available(counts.writeStream.outputMode("append").foreachBatch(sink), spark, "r01-alerts")
    ob = spark.read.schema("channel string, pipeline string, status string, payload string").json(path)
    return ob.select("channel", "pipeline", "status",
                     F.regexp_extract(F.get_json_object("payload", "$.line"), "Details: (.*)$", 1).alias("message"))


# ---------------------------------------------------------------- R2 / R3 with published state as an upsert log
def _events_in_parts(spark, sf, parts: int = 5):
    """The events as a stream of ``parts`` triggers, a share of the rows by hash each. A share is written by as many tasks as
    read it, unsorted, so no task holds more than its own split."""
    events = table(spark, sf, "events")
    folder = scratch_path(spark, "events-in-parts")
    share = F.pmod(F.xxhash64(*events.columns), F.lit(parts))
    for i in range(parts):
        events.where(share == i).write.parquet(f"{folder}/{i}")
    files = len(spark.read.schema(events.schema).parquet(f"{folder}/*").inputFiles())
    return file_stream(spark, f"{folder}/*", events.schema, max_files_per_trigger=max(1, -(-files // parts)))


@query("r02_stream_upserts", sql=ORACLES["m16_total_lag"])
def r02_stream_upserts(spark, sf):
    """The lag of r02, from a log of the partitions each trigger changed, compacted on the way."""
    use_utc(spark)
    cutoff = as_of_lit(EVENTS_AS_OF - dt.timedelta(days=1))
    progress = partition_progress(_events_in_parts(spark, sf), "event_type", "user_id", F.col("ts") < cutoff)
    log = StateLog(scratch_path(spark, "r02-log"), ["topic", "partition"], compact_every=3)
    run_available(progress.writeStream.outputMode("update").foreachBatch(log.append), spark, "r02-log")
    specs = specs_frame(spark, [{"pipeline": t, "check": "total_lag", "threshold": 65, "params": {"profile": "kafka"}} for t in TYPES])
    return out(evaluate(specs, M.total_lag(log.read(spark)), as_of=EVENTS_AS_OF))


@query("r03_stream_upserts", sql=ORACLES["r03_stream_freshness"])
def r03_stream_upserts(spark, sf):
    use_utc(spark)
    newest = newest_per_key(_events_in_parts(spark, sf), F.concat(F.lit("svc-"), F.col("user_id").cast("string")), "ts")
    log = StateLog(scratch_path(spark, "r03-log"), ["pipeline"], compact_every=2)
    run_available(newest.writeStream.outputMode("update").foreachBatch(log.append), spark, "r03-log")
    measures = M.age_hours(log.read(spark), "pipeline", "newest", as_of_lit(EVENTS_AS_OF))
    return out(evaluate(service_specs(spark, sf, "age_hours"), measures, as_of=EVENTS_AS_OF))
