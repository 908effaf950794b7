"""Specs, evaluation and report queries: E1, E2, E4, E5, E8, U1."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import q_counts, q_series
from suite.common import EVENTS_AS_OF, out, table
from suite.q_probes import STATIC_SQL, static_results
from suite.registry import ORACLES, query
from suite.sqlkit import ge, select_out
from vigil import operators as M
from vigil.operators.base import to_measures
from vigil.plans.evaluate import check_all, evaluate
from vigil.plans.registry import get_check, register_check
from vigil.plans.report import summary_text, tag_report
from vigil.plans.specs import specs_frame, specs_from_json


# ---------------------------------------------------------------- E1 specs from config rows
@query("e01_specs_from_json", sql="""
SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS pipeline, 'row_count' AS "check", 'ge' AS op, c_acctbal AS threshold,
       c_nationkey <> 0 AS alert_on_failure, '0 6 * * *' AS schedule, c_mktsegment AS first_tag,
       CAST(c_nationkey AS VARCHAR) AS region, c_mktsegment AS segment, 2 AS n_params
FROM customer
""")
def e01_specs_from_json(spark, sf):
    cust = table(spark, sf, "customer")
    config = F.to_json(F.struct(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("name"),
        F.lit("row_count").alias("check"), F.col("c_acctbal").alias("threshold"),
        F.lit("0 6 * * *").alias("schedule"), F.array("c_mktsegment").alias("tags"),
        (F.col("c_nationkey") != 0).alias("alert_on_failure"),
        F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("segment")))
    specs = specs_from_json(cust.select(config.alias("config")), "config")
    return specs.select("pipeline", "check", "op", "threshold", "alert_on_failure", "schedule",
                        F.try_element_at("tags", F.lit(1)).alias("first_tag"),
                        F.element_at("params", F.lit("region")).alias("region"),
                        F.element_at("params", F.lit("segment")).alias("segment"),
                        F.size("params").alias("n_params"))


# ---------------------------------------------------------------- E2 check_all over mixed checks
def mixed_inputs(spark, sf):
    orders = table(spark, sf, "orders")
    ev = table(spark, sf, "events")
    measures = [
        M.row_count(orders, "o_orderpriority").unionByName(
            M.row_count(orders, F.concat("o_orderpriority", F.lit("-OPEN")), where="o_orderstatus = 'O'")),
        M.latest_point(ev, "event_type", "ts", "value", tiebreak="event_id"),
    ]
    specs = specs_frame(spark, [{"pipeline": p, "check": "row_count", "threshold": t, "params": {"profile": "mysql"}}
                                for p, t in q_counts.M01_SPECS]
                        + [{"pipeline": t, "check": "latest_point", "threshold": 25.0, "params": {"profile": "datadog"}}
                           for t in q_series.TYPES])
    return specs, measures


def mixed_results(spark, sf):
    specs, measures = mixed_inputs(spark, sf)
    return check_all(specs, measures, as_of=EVENTS_AS_OF)


def checked_run(spark, sf):
    """The whole run: results checkpointed once, then outbox and report."""
    from vigil.plans.runner import run_checks
    specs, measures = mixed_inputs(spark, sf)
    return run_checks(specs, measures, REPORT_CHANNELS, as_of=EVENTS_AS_OF)


E02_SQL = f"SELECT * FROM ({ORACLES['m01_row_count']}) UNION ALL SELECT * FROM ({ORACLES['m09_latest_point']})"


@query("e02_check_all", sql=E02_SQL)
def e02_check_all(spark, sf):
    return out(mixed_results(spark, sf))


REPORT_CHANNELS = [{"type": "slack"}, {"type": "sms", "recipients": ["+15559990000", "+15558880000"]},
                   {"type": "webhook"}]


# ---------------------------------------------------------------- E4 run report (three channels; an SMS to two numbers is one send)
@query("e04_run_report", sql=f"""
WITH r AS ({E02_SQL})
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS healthy,
       count(*) FILTER (WHERE status <> 'ok') AS unhealthy, 3 * count(*) FILTER (WHERE status <> 'ok') AS alerts_sent,
       CASE WHEN count(*) FILTER (WHERE status <> 'ok') > 0 THEN 1 ELSE 0 END AS exit_code
FROM r
""")
def e04_run_report(spark, sf):
    return checked_run(spark, sf).report


# ---------------------------------------------------------------- E5 summary text
@query("e05_summary", sql=f"""
WITH r AS ({E02_SQL}),
a AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS healthy,
             count(*) FILTER (WHERE status <> 'ok') AS unhealthy FROM r)
SELECT 'Checked ' || total || ' pipeline(s): ' || healthy || ' healthy, ' || unhealthy || ' unhealthy. Alerts sent: '
       || (3 * unhealthy) || '.' AS summary
FROM a
""")
def e05_summary(spark, sf):
    return checked_run(spark, sf).report.select(summary_text().alias("summary"))


# ---------------------------------------------------------------- E8 tag report (rollup)
@query("e08_tag_report", sql=f"""
WITH r AS ({STATIC_SQL}),
t AS (SELECT unnest(CASE WHEN len(tags) = 0 THEN [NULL] ELSE tags END) AS tag, status FROM r)
SELECT tag, status, count(*) AS n, CAST(GROUPING(tag, status) AS INTEGER) AS level
FROM t GROUP BY ROLLUP (tag, status)
""")
def e08_tag_report(spark, sf):
    rep = tag_report(static_results(spark, sf))
    return rep.select("tag", "status", "n", F.col("level").cast("int").alias("level"))


# ---------------------------------------------------------------- U1 custom check by name
def revenue_by_key(df, key, check="revenue"):
    """A user check: exact revenue (decimal sum) per key."""
    agg = df.groupBy(F.col(key).alias("pipeline")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("v"))
    return to_measures(agg, check, value=F.col("v"))


register_check("Revenue_By_Flag", revenue_by_key)

U01_SPECS = [("A", 700000000.0), ("N", 700000000.0), ("R", 700000000.0)]


@query("u01_custom_check", sql=f"""
WITH m AS (SELECT l_returnflag AS pipeline, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1),
j AS (SELECT pipeline, v, 700000000.0 AS t FROM m WHERE pipeline IN ('A', 'N', 'R'))
SELECT {select_out("pipeline", "revenue", ge("v", "t", "revenue")[0], "v", "t", ge("v", "t", "revenue")[1])} FROM j
""")
def u01_custom_check(spark, sf):
    li = table(spark, sf, "lineitem")
    check_fn = get_check("revenue_by_flag")
    specs = specs_frame(spark, [{"pipeline": p, "check": "revenue", "threshold": t} for p, t in U01_SPECS])
    return out(evaluate(specs, check_fn(li, "l_returnflag"), as_of=EVENTS_AS_OF))




# ---------------------------------------------------------------- E3 is_healthy
@query("e03_is_healthy", sql=f"SELECT pipeline, \"check\", status, status = 'ok' AS healthy FROM ({E02_SQL})")
def e03_is_healthy(spark, sf):
    from vigil.plans.evaluate import healthy
    return healthy(mixed_results(spark, sf)).select("pipeline", "check", "status", "healthy")


# ---------------------------------------------------------------- U1 from SQL: verdict functions in a SQL check
@query("u01_sql_functions", sql="""
SELECT o_orderpriority AS pipeline, CAST(count(*) AS DOUBLE) AS value,
       CASE WHEN count(*) >= 3000 THEN 'ok' ELSE 'critical' END AS status,
       CASE WHEN max(o_orderdate) IS NULL THEN 'unknown'
            WHEN date_diff('microsecond', max(o_orderdate), TIMESTAMP '2001-08-02 00:00:00') / 3.6e9 <= 48 THEN 'ok'
            ELSE 'critical' END AS freshness,
       count(*) >= 3000 AS healthy
FROM orders GROUP BY 1
""")
def u01_sql_functions(spark, sf):
    from vigil.functions.sql import register_sql_functions
    from vigil.sources import register_views
    register_views(spark, sf, ["orders"])
    register_sql_functions(spark)
    return spark.sql("""
        SELECT o_orderpriority AS pipeline, CAST(count(*) AS DOUBLE) AS value,
               vg_ge(count(*), 3000) AS status,
               vg_max_age(timestampdiff(MICROSECOND, max(o_orderdate), TIMESTAMP_NTZ '2001-08-02 00:00:00') / 3.6e9, 48)
                   AS freshness,
               vg_is_healthy(vg_ge(count(*), 3000)) AS healthy
        FROM orders GROUP BY o_orderpriority""")
