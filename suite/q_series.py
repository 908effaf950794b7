"""Metric-series queries: M9-M15 (and V2, V14 int/float profiles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.common import EVENTS_AS_OF, EVENTS_AS_OF_SQL, events_as_of, out, table
from suite.registry import query
from suite.sqlkit import ge, gt, num, select_out, values
from vigil import operators as M
from vigil.plans.evaluate import evaluate
from vigil.plans.specs import normalize_specs, specs_frame

TYPES = ["signup", "view", "click", "error", "purchase", "refund"]


def _type_specs(spark, check, threshold, profile, op=None):
    rows = [{"pipeline": t, "check": check, "threshold": threshold, "params": {"profile": profile}} for t in TYPES]
    if op:
        for r in rows:
            r["op"] = op
    return specs_frame(spark, rows)


def _type_values():
    return values([(t,) for t in TYPES], ["pipeline"])


def _user_specs(events, check, threshold, profile, op=None, extra=True):
    users = events.select("user_id").distinct().select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("pipeline"),
        F.lit(check).alias("check"), F.lit(op).cast("string").alias("op"), F.lit(float(threshold)).alias("threshold"),
        F.create_map(F.lit("profile"), F.lit(profile)).alias("params"))
    specs = normalize_specs(users)
    if extra:
        specs = specs.unionByName(normalize_specs(events.sparkSession.createDataFrame(
            [("user-none", check, op, float(threshold), {"profile": profile})],
            "pipeline string, check string, op string, threshold double, params map<string,string>")))
    return specs


USER_SPECS_SQL = ("(SELECT DISTINCT 'user-' || CAST(user_id AS VARCHAR) AS pipeline FROM events "
                  "UNION ALL SELECT 'user-none')")


# ---------------------------------------------------------------- M9 latest_point
@query("m09_latest_point", sql=f"""
WITH r AS (SELECT event_type AS pipeline, value,
                  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
j AS (SELECT s.pipeline, r.value AS v, 25.0 AS t FROM {_type_values()} LEFT JOIN r ON r.pipeline = s.pipeline AND r.rn = 1)
SELECT {select_out("pipeline", "latest_point", ge("v", "t", "latest_point")[0], "v", "t", ge("v", "t", "latest_point")[1])} FROM j
""")
def m09_latest_point(spark, sf):
    ev = table(spark, sf, "events")
    measures = M.latest_point(ev, "event_type", "ts", "value", tiebreak="event_id")
    return out(evaluate(_type_specs(spark, "latest_point", 25.0, "datadog"), measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M10 trailing_range (+M9 per user)
@query("m10_trailing_range", sql=f"""
WITH w AS (SELECT * FROM events WHERE ts >= {EVENTS_AS_OF_SQL} - INTERVAL 360 MINUTE AND ts <= {EVENTS_AS_OF_SQL}),
r AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS pipeline, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM w),
j AS (SELECT s.pipeline, r.value AS v, 20.0 AS t FROM {USER_SPECS_SQL} s LEFT JOIN r ON r.pipeline = s.pipeline AND r.rn = 1)
SELECT {select_out("pipeline", "latest_point", ge("v", "t", "latest_point")[0], "v", "t", ge("v", "t", "latest_point")[1])} FROM j
""")
def m10_trailing_range(spark, sf):
    ev = table(spark, sf, "events")
    recent = M.trailing_range(ev, events_as_of(), 360, ts="ts")
    measures = M.latest_point(recent, F.concat(F.lit("user-"), F.col("user_id").cast("string")), "ts", "value", tiebreak="event_id")
    return out(evaluate(_user_specs(ev, "latest_point", 20.0, "datadog"), measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M11 windowed_stat
def _m11_sql():
    edge = f"{EVENTS_AS_OF_SQL} - INTERVAL 1 DAY"  # the newest period is [edge, as_of)
    st, msg = ge("v", "t", "windowed_stat")
    return f"""
WITH r AS (SELECT event_type AS pipeline, CASE WHEN ts >= {edge} THEN 0 ELSE 1 END AS b, value FROM events
           WHERE ts >= {EVENTS_AS_OF_SQL} - INTERVAL 2 DAY AND ts < {EVENTS_AS_OF_SQL}),
p AS (SELECT pipeline, b, CAST(sum(CAST(value AS DECIMAL(38,2))) AS DOUBLE) AS v FROM r GROUP BY 1, 2),
m AS (SELECT pipeline, COALESCE(arg_min(COALESCE(v, 0.0), b), 0.0) AS v FROM p GROUP BY 1),
j AS (SELECT s.pipeline, m.v, 1300.0 AS t FROM {_type_values()} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "windowed_stat", st, "v", "t", msg)} FROM j
"""


@query("m11_windowed_stat", sql=_m11_sql())
def m11_windowed_stat(spark, sf):
    ev = table(spark, sf, "events")
    measures = M.windowed_stat(ev, "event_type", events_as_of(), period_seconds=86400, stat="Sum", periods=2,
                               ts="ts", value="value", decimals=2)
    return out(evaluate(_type_specs(spark, "windowed_stat", 1300.0, "cloudwatch"), measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M12 instant_vector (V2 gt)
@query("m12_instant_vector", sql=f"""
WITH r AS (SELECT event_type AS pipeline, value,
                  row_number() OVER (PARTITION BY event_type ORDER BY user_id ASC, ts DESC, event_id DESC) AS rn FROM events),
j AS (SELECT s.pipeline, r.value AS v, 20.0 AS t FROM {_type_values()} LEFT JOIN r ON r.pipeline = s.pipeline AND r.rn = 1)
SELECT {select_out("pipeline", "instant_vector", gt("v", "t", "instant_vector")[0], "v", "t", gt("v", "t", "instant_vector")[1])} FROM j
""")
def m12_instant_vector(spark, sf):
    ev = table(spark, sf, "events")
    measures = M.instant_vector(ev, "event_type", "user_id", "ts", "value", tiebreak="event_id")
    return out(evaluate(_type_specs(spark, "instant_vector", 20.0, "prometheus", op="gt"), measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M13 first value of first row
@query("m13_first_value", sql=f"""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS pipeline, CAST(n AS DOUBLE) AS v,
             row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type ASC) AS rn FROM c),
j AS (SELECT s.pipeline, r.v, 20.0 AS t FROM {USER_SPECS_SQL} s LEFT JOIN r ON r.pipeline = s.pipeline AND r.rn = 1)
SELECT {select_out("pipeline", "first_value", ge("v", "t", "first_value")[0], "v", "t", ge("v", "t", "first_value")[1])} FROM j
""")
def m13_first_value(spark, sf):
    ev = table(spark, sf, "events")
    counts = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    measures = M.first_value(counts, F.concat(F.lit("user-"), F.col("user_id").cast("string")), "n",
                             order=[-F.col("n"), F.col("event_type")])
    return out(evaluate(_user_specs(ev, "first_value", 20.0, "newrelic"), measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M14 first line with field
def export_lines(ev):
    return (F.when(F.col("event_type") == "view", F.lit('{"other": 1}'))
            .when(F.col("event_type") == "error", F.lit('{"k": "n/a"}'))
            .when(F.col("event_type") == "click", F.lit('not json {'))
            .otherwise(F.col("props")))


EXPORT_LINES_SQL = """(SELECT *, CASE event_type WHEN 'view' THEN '{"other": 1}' WHEN 'error' THEN '{"k": "n/a"}'
                                  WHEN 'click' THEN 'not json {' ELSE props END AS line FROM events)"""


@query("m14_first_line_field", sql=f"""
WITH l AS (SELECT * FROM {EXPORT_LINES_SQL} WHERE json_valid(line) AND json_extract(line, '$.k') IS NOT NULL),
r AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS pipeline, json_extract_string(line, '$.k') AS raw,
             row_number() OVER (PARTITION BY user_id ORDER BY ts ASC, event_id ASC) AS rn FROM l),
j AS (SELECT s.pipeline, r.raw, TRY_CAST(trim(r.raw) AS DOUBLE) AS v, 50.0 AS t, r.raw IS NOT NULL AS present
      FROM {USER_SPECS_SQL} s LEFT JOIN r ON r.pipeline = s.pipeline AND r.rn = 1)
SELECT pipeline, 'first_line_field' AS "check",
       CASE WHEN v IS NULL THEN 'unknown' WHEN v >= t THEN 'ok' ELSE 'critical' END AS status, v AS value, t AS threshold,
       CASE WHEN NOT present THEN 'first_line_field: no data'
            WHEN v IS NULL THEN 'first_line_field: non-numeric value ''' || raw || ''''
            WHEN v >= t THEN 'first_line_field ' || {num('v')} || ' meets threshold 50'
            ELSE 'first_line_field ' || {num('v')} || ' below threshold 50' END AS message
FROM j
""")
def m14_first_line_field(spark, sf):
    ev = table(spark, sf, "events")
    lines = ev.select("user_id", "ts", "event_id", export_lines(ev).alias("line"))
    measures = M.first_line_with_field(lines, F.concat(F.lit("user-"), F.col("user_id").cast("string")), "line", "k",
                                       order=[F.col("ts"), F.col("event_id")])
    return out(evaluate(_user_specs(ev, "first_line_field", 50.0, "splunk"), measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M15 last row, last column
@query("m15_last_row_value", sql=f"""
WITH r AS (SELECT event_type AS pipeline, value,
                  row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, ts DESC, event_id DESC) AS rn FROM events),
j AS (SELECT s.pipeline, r.value AS v, 25.0 AS t FROM {_type_values()} LEFT JOIN r ON r.pipeline = s.pipeline AND r.rn = 1)
SELECT {select_out("pipeline", "last_row_value", ge("v", "t", "last_row_value")[0], "v", "t", ge("v", "t", "last_row_value")[1])} FROM j
""")
def m15_last_row_value(spark, sf):
    ev = table(spark, sf, "events")
    measures = M.last_row_value(ev, "event_type", "value", order=[F.col("user_id"), F.col("ts"), F.col("event_id")])
    return out(evaluate(_type_specs(spark, "last_row_value", 25.0, "influxdb"), measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- V14 profiles: int vs float on the same values
@query("v14_profiles", sql=f"""
WITH r AS (SELECT event_type AS pipeline, value - 20.5 AS x,
                  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
m AS (SELECT pipeline, x FROM r WHERE rn = 1),
b AS (SELECT s.pipeline, m.x FROM {_type_values()} LEFT JOIN m USING (pipeline)),
j AS (SELECT pipeline, 'float_value' AS c, x AS v, CASE WHEN x IS NULL THEN 'float_value: no data' END AS why FROM b
      UNION ALL
      SELECT pipeline, 'int_value', CASE WHEN x IS NULL THEN 0.0 ELSE trunc(x) END, NULL FROM b)
SELECT pipeline, c AS "check",
       CASE WHEN v IS NULL THEN 'unknown' WHEN v >= 0.0 THEN 'ok' ELSE 'critical' END AS status, v AS value, 0.0 AS threshold,
       CASE WHEN v IS NULL THEN why WHEN v >= 0.0 THEN c || ' ' || {num('v')} || ' meets threshold 0'
            ELSE c || ' ' || {num('v')} || ' below threshold 0' END AS message
FROM j
""")
def v14_profiles(spark, sf):
    ev = table(spark, sf, "events")
    shifted = ev.withColumn("x", F.col("value") - F.lit(20.5))
    as_float = M.latest_point(shifted, "event_type", "ts", "x", tiebreak="event_id", check="float_value")
    as_int = M.latest_point(shifted, "event_type", "ts", "x", tiebreak="event_id", check="int_value")
    specs = specs_frame(spark, [{"pipeline": t, "check": c, "threshold": 0.0, "params": {"profile": p}}
                                for t in TYPES for c, p in (("float_value", "postgres"), ("int_value", "trino"))])
    return out(evaluate(specs, as_float.unionByName(as_int), as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- V14 a source that fails is unknown under every profile
FAILING = [("mysql", "ge"), ("azure_eventhub", "le"), ("celery", "between"), ("postgres", "ge")]


@query("v14_failed_source", sql=f"""
WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM orders),
s(pipeline, op) AS (VALUES {", ".join(f"('{p}', '{o}')" for p, o in FAILING)})
SELECT pipeline, 'lost' AS "check", 'unknown' AS status, CAST(NULL AS DOUBLE) AS value, 1.0 AS threshold,
       'lost: source error' AS message FROM s
UNION ALL
SELECT pipeline, 'held', CASE WHEN op = 'ge' THEN CASE WHEN v >= 1 THEN 'ok' ELSE 'critical' END
                              WHEN v <= 1 THEN 'ok' ELSE 'critical' END, v, 1.0, NULL FROM s, n WHERE op IN ('ge', 'le')
""")
def v14_failed_source(spark, sf):
    orders = table(spark, sf, "orders")
    specs = specs_frame(spark, [{"pipeline": p, "check": c, "op": o, "threshold": 1.0, "max_threshold": 5.0, "params": {"profile": p}}
                                for p, o in FAILING for c in ("lost", "held") if c == "lost" or o in ("ge", "le")])
    lost = M.guarded(spark, lambda: M.row_count(spark.read.parquet(f"{sf}/no_such_table.parquet"), "x", check="lost"), "lost", specs)
    names = F.explode(F.array(*[F.lit(p) for p, o in FAILING if o in ("ge", "le")]))
    total = orders.agg(F.count(F.lit(1)).alias("n")).select("n", names.alias("p"))
    held = M.paged_count(total, "p", "n", check="held")
    results = out(evaluate(specs, lost.unionByName(held), as_of=EVENTS_AS_OF))
    return results.withColumn("message", F.when(F.col("check") == "lost", F.col("message")))
