"""Probe-log queries: M29-M33."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.common import EVENTS_AS_OF, PROBES_SQL, out, probes, table
from suite.registry import query
from suite.sqlkit import num
from vigil import operators as M
from vigil.plans.evaluate import evaluate
from vigil.plans.specs import normalize_specs

SERVICES_SQL = ("(SELECT DISTINCT 'svc-' || CAST(user_id AS VARCHAR) AS pipeline FROM events "
                "UNION ALL SELECT 'svc-none')")


def service_specs(spark, sf, check, op=None, threshold=None, expected=None, params=None):
    ev = table(spark, sf, "events")
    p = params or {}
    pm = F.create_map(*[x for k, v in p.items() for x in (F.lit(k), F.lit(v))]) if p else F.create_map()
    svc = ev.select("user_id").distinct().select(F.concat(F.lit("svc-"), F.col("user_id").cast("string")).alias("pipeline"))
    svc = svc.unionByName(spark.createDataFrame([("svc-none",)], "pipeline string"))
    return normalize_specs(svc.select(
        "pipeline", F.lit(check).alias("check"), F.lit(op).cast("string").alias("op"),
        F.lit(threshold).cast("double").alias("threshold"), F.lit(expected).cast("string").alias("expected"),
        pm.cast("map<string,string>").alias("params")))


def _newest_sql(cols: str) -> str:
    return f"""
WITH p AS ({PROBES_SQL}),
r AS (SELECT pipeline, {cols}, row_number() OVER (PARTITION BY pipeline ORDER BY ts DESC, event_id DESC) AS rn FROM p),
j AS (SELECT s.pipeline, r.* EXCLUDE (pipeline, rn), r.pipeline IS NOT NULL AS present
      FROM {SERVICES_SQL} s LEFT JOIN r ON r.pipeline = s.pipeline AND r.rn = 1)"""


def _doc_col():
    return (F.when(F.col("code") == 500, F.lit('{"k": "n/a"}'))
            .when(F.col("body").contains('"ok": 0'), F.lit('{"other": {}}'))
            .otherwise(F.col("props")))


DOC_SQL = """CASE WHEN code = 500 THEN '{"k": "n/a"}' WHEN contains(body, '"ok": 0') THEN '{"other": {}}' ELSE props END"""


# ---------------------------------------------------------------- M29 json_number
@query("m29_json_number", sql=_newest_sql(f"{DOC_SQL} AS doc") + f""",
k AS (SELECT *, TRY_CAST(json_extract_string(doc, '$.k') AS DOUBLE) AS v, json_extract(doc, '$.k') AS js FROM j)
SELECT pipeline, 'json_number' AS "check",
       CASE WHEN v IS NULL THEN 'unknown' WHEN v >= 50 THEN 'ok' ELSE 'critical' END AS status, v AS value, 50.0 AS threshold,
       CASE WHEN NOT present THEN 'json_number: no data' WHEN js IS NULL THEN 'json_number: null value'
            WHEN v IS NULL THEN 'json_number: non-numeric value ''' || CAST(js AS VARCHAR) || ''''
            WHEN v >= 50 THEN 'json_number ' || {num('v')} || ' meets threshold 50'
            ELSE 'json_number ' || {num('v')} || ' below threshold 50' END AS message
FROM k
""")
def m29_json_number(spark, sf):
    pr = probes(spark, sf).withColumn("doc", _doc_col())
    measures = M.json_number_measure(pr, "pipeline", "doc", "k", ts="ts", tiebreak="event_id")
    return out(evaluate(service_specs(spark, sf, "json_number", threshold=50.0), measures, as_of=EVENTS_AS_OF))


TRUTH_SQL = ("CASE WHEN json_extract(body, '$.status.ok') IS NULL THEN NULL "
             "WHEN CAST(json_extract(body, '$.status.ok') AS VARCHAR) IN ('null', 'false', '0', '\"\"', '[]', '{}') "
             "THEN 'falsy' ELSE 'truthy' END")


# ---------------------------------------------------------------- M30 json_truthy
@query("m30_json_truthy", sql=_newest_sql(f"{TRUTH_SQL} AS truth") + """
SELECT pipeline, 'json_truthy' AS "check",
       CASE WHEN NOT present THEN 'unknown' WHEN truth = 'truthy' THEN 'ok' WHEN truth = 'falsy' THEN 'critical'
            ELSE 'unknown' END AS status,
       CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS threshold,
       CASE WHEN NOT present THEN 'json_truthy: no data' WHEN truth IS NULL THEN 'json_truthy: path not found'
            ELSE 'json_truthy value is ' || truth END AS message
FROM j
""")
def m30_json_truthy(spark, sf):
    pr = probes(spark, sf)
    measures = M.json_truthy_measure(pr, "pipeline", "body", "status.ok", ts="ts", tiebreak="event_id")
    return out(evaluate(service_specs(spark, sf, "json_truthy"), measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M31 state_code (V12 eq)
@query("m31_state_code", sql=_newest_sql("CAST(health_code AS DOUBLE) AS c") + """
SELECT pipeline, 'state_code' AS "check",
       CASE WHEN c IS NULL THEN 'unknown' WHEN c = 1 THEN 'ok' ELSE 'critical' END AS status, c AS value, 1.0 AS threshold,
       CASE WHEN c IS NULL THEN 'state_code: no data' WHEN c = 1 THEN 'state_code 1 equals expected 1'
            ELSE 'state_code ' || CAST(CAST(c AS BIGINT) AS VARCHAR) || ', expected 1' END AS message
FROM j
""")
def m31_state_code(spark, sf):
    pr = probes(spark, sf)
    measures = M.state_code(pr, "pipeline", "health_code", ts="ts", tiebreak="event_id")
    return out(evaluate(service_specs(spark, sf, "state_code", expected="1"), measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M32 probe_status (V12 then V13)
@query("m32_probe_status", sql=_newest_sql(f"CAST(code AS DOUBLE) AS c, {TRUTH_SQL} AS truth") + """
SELECT pipeline, 'probe_status' AS "check",
       CASE WHEN NOT present THEN 'unknown' WHEN c <> 200 THEN 'critical' WHEN truth IS NULL THEN 'unknown'
            WHEN truth = 'falsy' THEN 'critical' ELSE 'ok' END AS status,
       c AS value, 200.0 AS threshold,
       CASE WHEN NOT present THEN 'probe_status: no data'
            WHEN c <> 200 THEN 'probe_status expected 200, got ' || CAST(CAST(c AS BIGINT) AS VARCHAR)
            WHEN truth IS NULL THEN 'probe_status: path not found'
            WHEN truth = 'falsy' THEN 'probe_status path resolved to falsy value'
            ELSE 'probe_status 200 OK' END AS message
FROM j
""")
def m32_probe_status(spark, sf):
    pr = probes(spark, sf)
    measures = M.probe_status(pr, "pipeline", "code", "body", path="status.ok", ts="ts", tiebreak="event_id")
    specs = service_specs(spark, sf, "probe_status", params={"json_path": "status.ok"})
    return out(evaluate(specs, measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M33 static_status
def static_results(spark, sf):
    """Nations as pipelines. Overrides by region: 1 warning 'slow', 2 critical
    'boom', 3 an invalid word, 4 critical with an empty message; regions 0 has
    none (default ok). Nation 7 does not alert on failure."""
    nation = table(spark, sf, "nation")
    rk = F.col("n_regionkey")
    overrides = nation.where(rk.isin(1, 2, 3, 4)).select(
        F.col("n_name").alias("pipeline"),
        F.when(rk == 1, "WARNING").when(rk == 2, "critical").when(rk == 3, "not_a_real_status").otherwise("FAILED").alias("status"),
        F.when(rk == 1, "slow").when(rk == 2, "boom").when(rk == 3, "odd").otherwise("").alias("message"),
        F.lit(None).cast("timestamp_ntz").alias("last_run"))
    specs = normalize_specs(nation.select(
        F.col("n_name").alias("pipeline"), F.lit("static_status").alias("check"),
        (F.col("n_nationkey") != 7).alias("alert_on_failure"),
        F.when(F.col("n_nationkey") < 5, F.array(F.lit("etl"), F.lit("prod"))).when(F.col("n_nationkey") < 15, F.array(F.lit("etl")))
        .otherwise(F.array().cast("array<string>")).alias("tags")))
    return evaluate(specs, M.static_status(overrides), as_of=EVENTS_AS_OF)


STATIC_SQL = """
SELECT n_name AS pipeline, n_nationkey,
       CASE n_regionkey WHEN 1 THEN 'warning' WHEN 2 THEN 'critical' WHEN 3 THEN 'unknown' WHEN 4 THEN 'critical' ELSE 'ok' END AS status,
       CASE n_regionkey WHEN 1 THEN 'slow' WHEN 2 THEN 'boom' WHEN 3 THEN 'odd' WHEN 4 THEN '' ELSE 'Static check for ' || n_name END AS message,
       n_nationkey <> 7 AS alert_on_failure,
       CASE WHEN n_nationkey < 5 THEN ['etl', 'prod'] WHEN n_nationkey < 15 THEN ['etl'] ELSE [] END AS tags
FROM nation"""


@query("m33_static_status", sql=f"""
SELECT pipeline, 'static_status' AS "check", status, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS threshold, message
FROM ({STATIC_SQL})
""")
def m33_static_status(spark, sf):
    return out(static_results(spark, sf))
