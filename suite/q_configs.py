"""Whole runs from configs that name a source kind: presets, source-level and required settings, isolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.common import EVENTS_AS_OF, EVENTS_AS_OF_SQL, ORDERS_AS_OF, events_as_of, out, table
from suite.registry import query
from suite.sqlkit import ge, num, select_out
from vigil.plans.runner import run_config

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


# ---------------------------------------------------------------- V14: one source fails while it is read
@query("v14_run_time_failure", sql=f"""
WITH m AS (SELECT o_orderpriority AS pipeline, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(v, 0.0) AS v, 310.0 AS t FROM (VALUES {", ".join(f"('{p}')" for p in [*PRIORITIES, "none"])}) s(pipeline) LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "row_count", ge("v", "t", "row_count")[0], "v", "t", ge("v", "t", "row_count")[1])} FROM j
UNION ALL SELECT 'depth-' || t, 'queue_depth', 'unknown', NULL, 1.0, 'queue_depth: source error' FROM (VALUES ('signup'), ('view')) q(t)
""")
def v14_run_time_failure(spark, sf):
    """Row counts of a MySQL-like source beside a source whose key fails to cast when it is read."""
    config = {"backend": "mysql", "backend_options": {"threshold": 310}, "pipelines": [
        *[{"name": p} for p in [*PRIORITIES, "none"]], *[{"name": f"depth-{t}", "check": "queue_depth", "queue": t} for t in ("signup", "view")]]}
    sources = {"mysql": {"df": table(spark, sf, "orders"), "key": "o_orderpriority"},
               "queue_depth": {"df": table(spark, sf, "events"), "key": F.col("event_type").cast("int")}}
    return out(run_config(spark, config, sources, as_of=ORDERS_AS_OF).results)


# ---------------------------------------------------------------- V15 / E1: bounds given once for the source
@query("v15_source_settings", sql=f"""
WITH m AS (SELECT event_type AS k, date_diff('microsecond', max(ts), {EVENTS_AS_OF_SQL}) / 3.6e9 AS v FROM events GROUP BY 1),
s(pipeline, k, h) AS (VALUES ('fresh', 'view', 1000.0), ('strict', 'view', 0.001), ('signups', 'signup', 30.0), ('gone', 'none', 30.0), ('unset', NULL, 30.0)),
j AS (SELECT s.pipeline, s.k, m.v, s.h AS t FROM s LEFT JOIN m USING (k))
SELECT pipeline, 'age_hours' AS "check", CASE WHEN v IS NULL THEN 'unknown' WHEN v <= t THEN 'ok' ELSE 'critical' END AS status, v AS value
FROM j
""")
def v15_source_settings(spark, sf):
    """Freshness with ``max_age_hours`` set for the source, overridden by two pipelines; one lacks its required setting."""
    config = {"backend": "tableau", "backend_options": {"max_age_hours": 30}, "pipelines": [
        {"name": "fresh", "datasource_id": "view", "max_age_hours": 1000}, {"name": "strict", "datasource_id": "view", "max_age_hours": 0.001},
        {"name": "signups", "datasource_id": "signup"}, {"name": "gone", "datasource_id": "none"}, {"name": "unset"}]}
    sources = {"tableau": {"df": table(spark, sf, "events"), "key": "event_type", "updated_at": "ts", "as_of": events_as_of()}}
    return run_config(spark, config, sources, as_of=EVENTS_AS_OF).results.select("pipeline", "check", "status", "value")


# ---------------------------------------------------------------- V14: required settings by default
@query("v14_required_settings", sql=f"""
WITH m AS (SELECT role AS k, CAST(count(*) AS DOUBLE) AS n FROM conversations GROUP BY 1),
s(pipeline, k) AS (VALUES ('users', 'user'), ('idle', 'nobody'), ('user', NULL)),
j AS (SELECT s.pipeline, CASE WHEN s.k IS NOT NULL THEN COALESCE(n, 0.0) END AS v FROM s LEFT JOIN m USING (k))
SELECT pipeline, 'queue_depth' AS "check", CASE WHEN v IS NULL THEN 'unknown' WHEN v >= 5 THEN 'ok' ELSE 'critical' END AS status, v AS value, 5.0 AS threshold,
       CASE WHEN v IS NULL THEN 'queue_depth: missing setting ''queue''' WHEN v >= 5 THEN 'queue_depth ' || {num('v')} || ' meets threshold 5'
            ELSE 'queue_depth ' || {num('v')} || ' below threshold 5' END AS message
FROM j
""")
def v14_required_settings(spark, sf):
    """A pipeline without its queue is unknown, though a queue of its own name exists."""
    config = {"backend": "rabbitmq", "backend_options": {"threshold": "5"}, "pipelines": [
        {"name": "users", "queue": "user"}, {"name": "idle", "queue": "nobody"}, {"name": "user"}]}
    return out(run_config(spark, config, {"rabbitmq": {"df": table(spark, sf, "conversations"), "key": "role"}}, as_of=EVENTS_AS_OF).results)
