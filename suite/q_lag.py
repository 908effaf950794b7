"""Lag, backlog and task queries: M16-M19, M21, M22."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from suite.common import EVENTS_AS_OF, EVENTS_AS_OF_SQL, out, table
from suite.registry import query
from suite.sqlkit import gt, le, num, select_out, values
from vigil import operators as M
from vigil.plans.evaluate import as_of_lit, evaluate
from vigil.plans.specs import specs_frame
from vigil.sources.offsets import offsets_from_log

TYPES = ["signup", "view", "click", "error", "purchase", "refund"]
TYPE_ROWS = values([(t,) for t in TYPES], ["pipeline"])


def offsets(spark, sf, days_behind: int):
    ev = table(spark, sf, "events")
    cutoff = as_of_lit(EVENTS_AS_OF - dt.timedelta(days=days_behind))
    return offsets_from_log(ev, "event_type", "user_id", F.col("ts") < cutoff)


def offsets_sql(days_behind: int) -> str:
    return (f"(SELECT event_type AS topic, user_id AS partition, count(*) AS end_offset, "
            f"NULLIF(count(*) FILTER (WHERE ts < {EVENTS_AS_OF_SQL} - INTERVAL {days_behind} DAY), 0) AS committed "
            f"FROM events GROUP BY 1, 2)")


# ---------------------------------------------------------------- M16 total_lag
@query("m16_total_lag", sql=f"""
WITH m AS (SELECT topic AS pipeline, CAST(sum(greatest(end_offset - COALESCE(committed, 0), 0)) AS DOUBLE) AS v
           FROM {offsets_sql(1)} GROUP BY 1),
j AS (SELECT s.pipeline, m.v, 65.0 AS t FROM {TYPE_ROWS} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "total_lag", le("v", "t", "total_lag")[0], "v", "t", le("v", "t", "total_lag")[1])} FROM j
""")
def m16_total_lag(spark, sf):
    specs = specs_frame(spark, [{"pipeline": t, "check": "total_lag", "threshold": 65, "params": {"profile": "kafka"}}
                                for t in TYPES])
    return out(evaluate(specs, M.total_lag(offsets(spark, sf, 1)), as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M17 total_lag_received
@query("m17_total_lag_received", sql=f"""
WITH m AS (SELECT topic AS pipeline, CAST(sum(greatest(end_offset - COALESCE(committed, end_offset), 0)) AS DOUBLE) AS v
           FROM {offsets_sql(25)} GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(m.v, 0.0) AS v, 1680.0 AS t FROM {TYPE_ROWS} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "total_lag_received", le("v", "t", "total_lag_received")[0], "v", "t", le("v", "t", "total_lag_received")[1])} FROM j
""")
def m17_total_lag_received(spark, sf):
    o = offsets(spark, sf, 25).withColumnRenamed("committed", "last_read")
    specs = specs_frame(spark, [{"pipeline": t, "check": "total_lag_received", "threshold": 1680,
                                 "params": {"profile": "azure_eventhub"}} for t in TYPES])
    return out(evaluate(specs, M.total_lag_received(o), as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M18 max_lag_ms (V15 source default)
M18_SPECS = [("signup", 691200000.0), ("view", 691200000.0), ("click", None), ("error", 691200000.0),
             ("purchase", 864000000.0), ("refund", None)]


@query("m18_max_lag_ms", sql=f"""
WITH sh AS (SELECT event_type AS stream, user_id AS shard, date_diff('microsecond', max(ts), {EVENTS_AS_OF_SQL}) // 1000 AS lag_ms
            FROM events GROUP BY 1, 2),
m AS (SELECT stream AS pipeline, CAST(max(COALESCE(lag_ms, 0)) AS DOUBLE) AS v FROM sh GROUP BY 1),
j AS (SELECT s.pipeline, m.v, COALESCE(s.threshold, 60000.0) AS t
      FROM {values(M18_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "max_lag_ms", le("v", "t", "max_lag_ms")[0], "v", "t", le("v", "t", "max_lag_ms")[1])} FROM j
""")
def m18_max_lag_ms(spark, sf):
    ev = table(spark, sf, "events")
    shards = M.shard_lags(ev, "event_type", "user_id", "ts", as_of_lit(EVENTS_AS_OF))
    specs = specs_frame(spark, [{"pipeline": p, "check": "max_lag_ms", "threshold": t, "params": {"profile": "kinesis"}}
                                for p, t in M18_SPECS])
    return out(evaluate(specs, M.max_lag_ms(shards), as_of=EVENTS_AS_OF, defaults={"max_lag_ms": 60000.0}))


# ---------------------------------------------------------------- M19 backlog (V4 sentinel -1)
M19_SPECS = [("signup", 30.0), ("view", -1.0), ("click", 30.0), ("error", 25.0), ("purchase", 0.0), ("refund", 10.0)]


@query("m19_backlog", sql=f"""
WITH a AS (SELECT user_id, max(ts) AS until FROM events WHERE event_type = 'purchase' GROUP BY 1),
m AS (SELECT e.event_type AS pipeline, CAST(count(*) FILTER (WHERE a.until IS NULL OR e.ts > a.until) AS DOUBLE) AS v
      FROM events e LEFT JOIN a USING (user_id) GROUP BY 1),
j AS (SELECT s.pipeline, m.v, s.threshold AS t FROM {values(M19_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT pipeline, 'backlog' AS "check",
       CASE WHEN v IS NULL THEN 'unknown' WHEN t = -1 OR v <= t THEN 'ok' ELSE 'critical' END AS status,
       v AS value, t AS threshold,
       CASE WHEN v IS NULL THEN 'backlog: no data'
            WHEN t = -1 THEN 'backlog ' || {num('v')} || ', any value accepted'
            WHEN v <= t THEN 'backlog ' || {num('v')} || ' within threshold ' || {num('t')}
            ELSE 'backlog ' || {num('v')} || ' exceeds threshold ' || {num('t')} END AS message
FROM j
""")
def m19_backlog(spark, sf):
    ev = table(spark, sf, "events")
    acks = ev.where(F.col("event_type") == "purchase")
    measures = M.backlog_until(ev, acks, match="user_id", ts="ts", key="event_type")
    specs = specs_frame(spark, [{"pipeline": p, "check": "backlog", "op": "le_any", "threshold": t,
                                 "params": {"profile": "pubsub"}} for p, t in M19_SPECS])
    return out(evaluate(specs, measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M21 active_tasks (V5 between)
M21_SPECS = [("user", 100.0, 400.0), ("assistant", 10.0, None), ("opening", 200.0, 250.0), ("system", 0.0, None),
             ("tool", 1.0, None)]


def task_map(conv):
    task = F.struct(F.struct(F.col("role").alias("routing_key"),
                             F.when(F.col("turn") == 0, F.lit("opening")).alias("exchange")).alias("delivery_info"))
    return F.create_map(F.concat(F.lit("worker-"), F.col("conv_id").cast("string")), F.array(task))


@query("m21_active_tasks", sql=f"""
WITH t AS (SELECT role AS rk, CASE WHEN turn = 0 THEN 'opening' END AS ex FROM conversations),
q AS (SELECT rk AS queue FROM t WHERE rk IS NOT NULL
      UNION ALL SELECT ex FROM t WHERE ex IS NOT NULL AND ex IS DISTINCT FROM rk),
m AS (SELECT queue AS pipeline, CAST(count(*) AS DOUBLE) AS n FROM q GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(m.n, 0.0) AS v, s.lo, s.hi
      FROM {values(M21_SPECS, ["pipeline", "lo", "hi"])} LEFT JOIN m USING (pipeline))
SELECT pipeline, 'active_tasks' AS "check",
       CASE WHEN v < lo THEN 'critical' WHEN hi IS NOT NULL AND v > hi THEN 'critical' ELSE 'ok' END AS status,
       v AS value, lo AS threshold,
       CASE WHEN NOT (v < lo) AND NOT (hi IS NOT NULL AND v > hi) THEN 'active_tasks ' || {num('v')} || ' within bounds'
            WHEN v < lo THEN 'active_tasks ' || {num('v')} || ' below minimum ' || {num('lo')}
            ELSE 'active_tasks ' || {num('v')} || ' above maximum ' || {num('hi')} END AS message
FROM j
""")
def m21_active_tasks(spark, sf):
    conv = table(spark, sf, "conversations")
    workers = conv.select(task_map(conv).alias("tasks"))
    specs = specs_frame(spark, [{"pipeline": p, "check": "active_tasks", "threshold": lo, "max_threshold": hi,
                                 "params": {"profile": "celery"}} for p, lo, hi in M21_SPECS])
    return out(evaluate(specs, M.active_tasks(workers, "tasks"), as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M21 bound by the setting ``queue`` (V14 where it is unset)
BOUND_SPECS = [("nightly-users", "user", 100.0, 400.0), ("second-users", "user", 0.0, None), ("nightly-tools", "tool", 1.0, None),
               ("nightly-absent", "nobody", 1.0, None), ("user", None, 0.0, None)]


@query("m21_bound_queue", sql=f"""
WITH m AS (SELECT role AS queue, CAST(count(*) AS DOUBLE) AS n FROM conversations GROUP BY 1),
j AS (SELECT s.pipeline, CASE WHEN s.queue IS NOT NULL THEN COALESCE(m.n, 0.0) END AS v, s.lo, s.hi
      FROM {values(BOUND_SPECS, ["pipeline", "queue", "lo", "hi"])} LEFT JOIN m USING (queue))
SELECT pipeline, 'active_tasks' AS "check",
       CASE WHEN v IS NULL THEN 'unknown' WHEN v < lo OR v > hi THEN 'critical' ELSE 'ok' END AS status, v AS value, lo AS threshold,
       CASE WHEN v IS NULL THEN 'active_tasks: missing setting ''queue'''
            WHEN v < lo THEN 'active_tasks ' || {num('v')} || ' below minimum ' || {num('lo')}
            WHEN v > hi THEN 'active_tasks ' || {num('v')} || ' above maximum ' || {num('hi')}
            ELSE 'active_tasks ' || {num('v')} || ' within bounds' END AS message
FROM j
""")
def m21_bound_queue(spark, sf):
    conv = table(spark, sf, "conversations")
    workers = conv.select(task_map(conv).alias("tasks"))
    specs = specs_frame(spark, [{"pipeline": p, "check": "active_tasks", "threshold": lo, "max_threshold": hi,
                                 "params": {"profile": "celery", "queue": queue}} for p, queue, lo, hi in BOUND_SPECS])
    measures = M.bind(specs, M.active_tasks(workers, "tasks"), required=["active_tasks"])
    return out(evaluate(specs, measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M22 messages_in_window (V2 gt)
M22_SPECS = [("signup", 10.0), ("view", None), ("click", 10.0), ("error", 12.0), ("purchase", None), ("refund", None)]


@query("m22_messages_in_window", sql=f"""
WITH m AS (SELECT event_type AS pipeline, CAST(count(*) AS DOUBLE) AS n FROM events
           WHERE ts >= {EVENTS_AS_OF_SQL} - INTERVAL 6 HOUR AND ts < {EVENTS_AS_OF_SQL} GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(m.n, 0.0) AS v, COALESCE(s.threshold, 0.0) AS t
      FROM {values(M22_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "messages_in_window", gt("v", "t", "messages_in_window")[0], "v", "t", gt("v", "t", "messages_in_window")[1])} FROM j
""")
def m22_messages_in_window(spark, sf):
    ev = table(spark, sf, "events")
    measures = M.messages_in_window(ev, "event_type", as_of_lit(EVENTS_AS_OF), 6 * 3600)
    specs = specs_frame(spark, [{"pipeline": p, "check": "messages_in_window", "threshold": t,
                                 "params": {"profile": "mqtt"}} for p, t in M22_SPECS])
    return out(evaluate(specs, measures, as_of=EVENTS_AS_OF))
