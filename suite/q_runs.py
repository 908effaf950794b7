"""Run-history queries: M27, M28 with V8-V11 and the duration SLA E9."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.common import ORDERS_AS_OF, out, table
from suite.registry import query
from suite.sqlkit import num
from vigil import operators as M
from vigil.plans.evaluate import evaluate, result_line
from vigil.plans.specs import normalize_specs
from vigil.sources.runs import runs_frame


def runs(spark, sf, flavor: str):
    """orders as run history: job = customer, run = order, start = order date.
    F / O / P are mapped to each scheduler's state words."""
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus")
    if flavor == "airflow":
        state = F.when(st == "F", "success").when(st == "O", "running").otherwise("failed")
        life = F.lit(None)
    elif flavor == "dbt":
        state = (F.when(st == "F", "Success").when(st == "O", "Running")
                 .when(F.col("o_orderpriority") == "5-LOW", "Cancelled").otherwise("Error"))
        life = F.lit(None)
    else:
        state = (F.when(st == "F", "SUCCESS").when(st == "O", F.lit(None))
                 .when(F.col("o_orderpriority") == "1-URGENT", "TIMEDOUT").otherwise("FAILED"))
        life = F.when(st == "O", "RUNNING").otherwise("TERMINATED")
    return runs_frame(o, job=F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")), run_id="o_orderkey",
                      started="o_orderdate", state=state, life_cycle=life,
                      duration_ms=F.col("o_totalprice") * F.lit(10.0))


def run_specs(spark, sf, op: str, max_duration=None):
    cust = table(spark, sf, "customer")
    return normalize_specs(cust.select(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("pipeline"),
        F.lit("latest_run").alias("check"), F.lit(op).alias("op"),
        F.lit(max_duration).cast("int").alias("max_duration_seconds")))


def run_results(spark, sf, flavor: str, op: str, max_duration=None):
    r = runs(spark, sf, flavor)
    measures = M.latest_run(r, "job", "started", "run_id", "state", life_cycle="life_cycle", duration_ms="duration_ms")
    return evaluate(run_specs(spark, sf, op, max_duration), measures, as_of=ORDERS_AS_OF)


def _latest_sql(state_case: str, life_case: str = "NULL") -> str:
    return f"""
WITH r AS (SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS pipeline, {state_case} AS state, {life_case} AS life,
                  CAST(trunc(o_totalprice * 10.0) AS DOUBLE) AS dur, o_orderdate AS started,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
s AS (SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS pipeline FROM customer),
j AS (SELECT s.pipeline, r.state, r.life, r.dur, r.started, r.pipeline IS NOT NULL AS present
      FROM s LEFT JOIN r ON r.pipeline = s.pipeline AND r.rn = 1)"""


AIRFLOW_STATE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END"


# ---------------------------------------------------------------- M27 latest_run + V8
@query("m27_latest_run", sql=_latest_sql(AIRFLOW_STATE_SQL) + """
SELECT pipeline, 'latest_run' AS "check",
       CASE WHEN NOT present THEN 'unknown' WHEN lower(state) = 'success' THEN 'ok'
            WHEN lower(state) IN ('failed', 'upstream_failed', 'skipped') THEN 'critical' ELSE 'unknown' END AS status,
       dur AS value, CAST(NULL AS DOUBLE) AS threshold,
       CASE WHEN NOT present THEN 'latest_run: no data' ELSE 'latest_run state=' || COALESCE(state, 'null') END AS message
FROM j
""")
def m27_latest_run(spark, sf):
    return out(run_results(spark, sf, "airflow", "state_airflow"))


# ---------------------------------------------------------------- V9 dbt state table
@query("v09_state_dbt", sql=_latest_sql(
    "CASE WHEN o_orderstatus = 'F' THEN 'Success' WHEN o_orderstatus = 'O' THEN 'Running' "
    "WHEN o_orderpriority = '5-LOW' THEN 'Cancelled' ELSE 'Error' END") + """
SELECT pipeline, 'latest_run' AS "check",
       CASE WHEN NOT present THEN 'unknown' WHEN state = 'Success' THEN 'ok'
            WHEN state IN ('Error', 'Cancelled') THEN 'critical' ELSE 'unknown' END AS status,
       dur AS value, CAST(NULL AS DOUBLE) AS threshold,
       CASE WHEN NOT present THEN 'latest_run: no data' ELSE 'latest_run state=' || COALESCE(state, 'null') END AS message
FROM j
""")
def v09_state_dbt(spark, sf):
    return out(run_results(spark, sf, "dbt", "state_dbt"))


# ---------------------------------------------------------------- V10 two-level state
@query("v10_state_databricks", sql=_latest_sql(
    "CASE WHEN o_orderstatus = 'F' THEN 'SUCCESS' WHEN o_orderstatus = 'O' THEN NULL "
    "WHEN o_orderpriority = '1-URGENT' THEN 'TIMEDOUT' ELSE 'FAILED' END",
    "CASE WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'TERMINATED' END") + """
SELECT pipeline, 'latest_run' AS "check",
       CASE WHEN NOT present THEN 'unknown' WHEN COALESCE(life = 'TERMINATED', FALSE) = FALSE THEN 'unknown'
            WHEN state = 'SUCCESS' THEN 'ok' WHEN state IN ('FAILED', 'TIMEDOUT', 'CANCELED') THEN 'critical'
            ELSE 'unknown' END AS status,
       dur AS value, CAST(NULL AS DOUBLE) AS threshold,
       CASE WHEN NOT present THEN 'latest_run: no data'
            WHEN COALESCE(life = 'TERMINATED', FALSE) THEN 'latest_run result=' || COALESCE(state, 'null')
            ELSE 'latest_run not terminated (life_cycle=' || COALESCE(life, 'null') || ')' END AS message
FROM j
""")
def v10_state_databricks(spark, sf):
    return out(run_results(spark, sf, "databricks", "state_databricks"))


# ---------------------------------------------------------------- E9 duration SLA
@query("e09_duration_sla", sql=_latest_sql(AIRFLOW_STATE_SQL) + f""",
k AS (SELECT *, CASE WHEN NOT present THEN 'unknown' WHEN lower(state) = 'success' THEN 'ok'
                     WHEN lower(state) IN ('failed', 'upstream_failed', 'skipped') THEN 'critical' ELSE 'unknown' END AS base,
             CASE WHEN NOT present THEN 'latest_run: no data' ELSE 'latest_run state=' || COALESCE(state, 'null') END AS msg
      FROM j)
SELECT pipeline, 'latest_run' AS "check",
       CASE WHEN base = 'ok' AND dur > 1500000.0 THEN 'warning' ELSE base END AS status,
       dur AS value, CAST(NULL AS DOUBLE) AS threshold,
       CASE WHEN base = 'ok' AND dur > 1500000.0 THEN msg || '; run took ' || {num('dur / 1000.0')} || ' s, over 1500 s'
            ELSE msg END AS message
FROM k
""")
def e09_duration_sla(spark, sf):
    return out(run_results(spark, sf, "airflow", "state_airflow", max_duration=1500))


# ---------------------------------------------------------------- E6 result line
@query("e06_result_line", sql=_latest_sql(AIRFLOW_STATE_SQL) + """
SELECT pipeline,
       '[' || upper(CASE WHEN NOT present THEN 'unknown' WHEN lower(state) = 'success' THEN 'ok'
                         WHEN lower(state) IN ('failed', 'upstream_failed', 'skipped') THEN 'critical' ELSE 'unknown' END)
       || '] ' || pipeline || ' (last_run=' || COALESCE(strftime(started, '%Y-%m-%dT%H:%M:%S'), 'N/A') || '): '
       || CASE WHEN NOT present THEN 'latest_run: no data' ELSE 'latest_run state=' || COALESCE(state, 'null') END AS line
FROM j
""")
def e06_result_line(spark, sf):
    res = run_results(spark, sf, "airflow", "state_airflow")
    return res.select("pipeline", result_line(res).alias("line"))


# ---------------------------------------------------------------- M28 latest_attempt among the newest 20
@query("m28_latest_attempt", sql="""
WITH top AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20),
r AS (SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS pipeline, o_orderstatus <> 'O' AS completed,
             CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE CAST(trunc(o_totalprice * 10.0) AS DOUBLE) END AS dur,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM top),
s AS (SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS pipeline FROM customer),
j AS (SELECT s.pipeline, r.completed, r.dur, r.pipeline IS NOT NULL AS present FROM s LEFT JOIN r ON r.pipeline = s.pipeline AND r.rn = 1)
SELECT pipeline, 'latest_attempt' AS "check",
       CASE WHEN NOT present THEN 'unknown' WHEN NOT completed THEN 'unknown' WHEN dur > 0 THEN 'ok' ELSE 'critical' END AS status,
       dur AS value, CAST(NULL AS DOUBLE) AS threshold,
       CASE WHEN NOT present THEN 'latest_attempt: no data' WHEN NOT completed THEN 'latest_attempt attempt not completed'
            ELSE 'latest_attempt completed in ' || CAST(CAST(dur AS BIGINT) AS VARCHAR) || ' ms' END AS message
FROM j
""")
def m28_latest_attempt(spark, sf):
    o = table(spark, sf, "orders")
    attempts = F.array(F.struct((F.col("o_orderstatus") != "O").alias("completed"),
                                F.when(F.col("o_orderstatus") == "P", F.lit(0)).otherwise(
                                    (F.col("o_totalprice") * F.lit(10.0)).cast("long")).alias("duration")))
    apps = o.select(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("name"), "o_orderdate", "o_orderkey",
                    attempts.alias("attempts"))
    measures = M.latest_attempt(apps, "name", "o_orderdate", "o_orderkey", "attempts", top_n=20)
    cust = table(spark, sf, "customer")
    specs = normalize_specs(cust.select(F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("pipeline"),
                                        F.lit("latest_attempt").alias("check")))
    return out(evaluate(specs, measures, as_of=ORDERS_AS_OF))


# ---------------------------------------------------------------- one scan of orders for three checks
def _one_scan_sql():
    from suite.registry import ORACLES
    return " UNION ALL ".join(f"SELECT * FROM ({ORACLES[n]})" for n in ("m25_recent_objects", "m26_age_hours", "m27_latest_run"))


@query("e02_one_scan_many_checks", sql=_one_scan_sql())
def e02_one_scan_many_checks(spark, sf):
    from suite.q_files import _customer_specs
    from vigil.operators.base import hours_between
    from vigil.plans.evaluate import as_of_lit
    o = table(spark, sf, "orders")
    as_of = as_of_lit(ORDERS_AS_OF)
    st = F.col("o_orderstatus")
    state = F.when(st == "F", "success").when(st == "O", "running").otherwise("failed")
    run = M.newest_row([F.col("o_orderdate"), F.col("o_orderkey")], state=state, started=F.col("o_orderdate"),
                       dur=(F.col("o_totalprice") * F.lit(10.0)).cast("long"))
    newest_done = F.max(F.when(st != "P", F.col("o_orderdate")))
    measures = M.measure_many(o, F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")), {
        "recent_objects": {"value": F.count(F.lit(1)), "aux": hours_between(F.max("o_orderdate"), as_of),
                           "observed_at": F.max("o_orderdate")},
        "age_hours": {"value": hours_between(newest_done, as_of), "observed_at": newest_done},
        "latest_run": {"state": run["state"], "value": run["dur"], "observed_at": run["started"]},
    })
    specs = (_customer_specs(spark, sf, "recent_objects", 10.0, F.when(F.col("c_nationkey") < 12, F.lit(8760.0)))
             .unionByName(_customer_specs(spark, sf, "age_hours", None, F.lit(8760.0)))
             .unionByName(run_specs(spark, sf, "state_airflow")))
    return out(evaluate(specs, measures, as_of=ORDERS_AS_OF))
