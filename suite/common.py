"""Shared pieces of the registered queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.plans.evaluate import as_of_lit
from vigil.session import use_utc

# Fixed evaluation times of the test data (events span January 2024, orders
# 1995 to mid 2001).
EVENTS_AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
ORDERS_AS_OF = dt.datetime(2001, 8, 2, 0, 0, 0)
EVENTS_AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
ORDERS_AS_OF_SQL = "TIMESTAMP '2001-08-02 00:00:00'"

OUT = ["pipeline", "check", "status", "value", "threshold", "message"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    from vigil.sources.tables import parquet_table
    use_utc(spark)
    return parquet_table(spark, f"{sf.rstrip('/')}/{name}.parquet")


def out(results: DataFrame) -> DataFrame:
    return results.select(*OUT)


def events_as_of():
    return as_of_lit(EVENTS_AS_OF)


def orders_as_of():
    return as_of_lit(ORDERS_AS_OF)


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """A probe log derived from events: one probe per event of service
    ``svc-<user_id>``; errors answer 500, others 200; the body's ``status.ok``
    depends on the event type (true, 0, null, missing, "false")."""
    ev = table(spark, sf, "events")
    body = (F.when(F.col("event_type") == "signup", F.lit('{"status": {"ok": true}, "k": 1}'))
            .when(F.col("event_type") == "view", F.lit('{"status": {"ok": 0}}'))
            .when(F.col("event_type") == "click", F.lit('{"status": {"ok": null}}'))
            .when(F.col("event_type") == "error", F.lit('{"status": {}}'))
            .otherwise(F.lit('{"status": {"ok": "false"}}')))
    return ev.select(
        F.concat(F.lit("svc-"), F.col("user_id").cast("string")).alias("pipeline"),
        F.col("ts"), F.col("event_id"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("code"),
        F.when(F.col("event_type") == "error", F.lit(2)).otherwise(F.lit(1)).alias("health_code"),
        body.alias("body"),
        F.col("props"),
    )


PROBES_SQL = """
SELECT 'svc-' || CAST(user_id AS VARCHAR) AS pipeline, ts, event_id,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS code,
       CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS health_code,
       CASE event_type WHEN 'signup' THEN '{"status": {"ok": true}, "k": 1}'
                       WHEN 'view' THEN '{"status": {"ok": 0}}'
                       WHEN 'click' THEN '{"status": {"ok": null}}'
                       WHEN 'error' THEN '{"status": {}}'
                       ELSE '{"status": {"ok": "false"}}' END AS body,
       props
FROM events
"""
