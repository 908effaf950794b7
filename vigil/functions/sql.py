"""The verdicts as SQL functions, for checks written as SQL strings.

They are SQL-language functions (``CREATE TEMPORARY FUNCTION ... RETURN expr``):
Spark inlines their bodies into the plan like built-ins, so they run inside
whole-stage codegen with no Python involved.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# The same rules as vigil.functions.verdicts, in SQL.
SQL_FUNCTIONS = {
    "vg_is_healthy": ("status STRING", "BOOLEAN", "coalesce(status = 'ok', false)"),
    "vg_ge": ("v DOUBLE, t DOUBLE", "STRING",
              "CASE WHEN v IS NULL THEN 'unknown' WHEN isnan(v) THEN 'critical' WHEN v >= t THEN 'ok' ELSE 'critical' END"),
    "vg_gt": ("v DOUBLE, t DOUBLE", "STRING",
              "CASE WHEN v IS NULL THEN 'unknown' WHEN isnan(v) THEN 'critical' WHEN v > t THEN 'ok' ELSE 'critical' END"),
    "vg_le": ("v DOUBLE, t DOUBLE", "STRING",
              "CASE WHEN v IS NULL THEN 'unknown' WHEN isnan(v) THEN 'critical' WHEN v <= t THEN 'ok' ELSE 'critical' END"),
    "vg_between": ("v DOUBLE, lo DOUBLE, hi DOUBLE", "STRING",
                   "CASE WHEN v IS NULL THEN 'unknown' WHEN isnan(v) THEN 'critical' WHEN v < lo THEN 'critical' "
                   "WHEN hi IS NOT NULL AND v > hi THEN 'critical' ELSE 'ok' END"),
    "vg_max_age": ("age_hours DOUBLE, max_hours DOUBLE", "STRING",
                   "CASE WHEN age_hours IS NULL THEN 'unknown' WHEN isnan(age_hours) THEN 'critical' "
                   "WHEN age_hours <= coalesce(max_hours, 24.0) THEN 'ok' ELSE 'critical' END"),
    "vg_state_airflow": ("state STRING", "STRING",
                         "CASE lower(state) WHEN 'success' THEN 'ok' WHEN 'failed' THEN 'critical' "
                         "WHEN 'upstream_failed' THEN 'critical' WHEN 'skipped' THEN 'critical' ELSE 'unknown' END"),
    "vg_state_dbt": ("state STRING", "STRING",
                     "CASE state WHEN 'Success' THEN 'ok' WHEN 'Error' THEN 'critical' WHEN 'Cancelled' THEN 'critical' "
                     "ELSE 'unknown' END"),
    "vg_state_databricks": ("life_cycle STRING, result STRING", "STRING",
                            "CASE WHEN coalesce(life_cycle = 'TERMINATED', false) = false THEN 'unknown' "
                            "WHEN result = 'SUCCESS' THEN 'ok' WHEN result IN ('FAILED', 'TIMEDOUT', 'CANCELED') "
                            "THEN 'critical' ELSE 'unknown' END"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Creates (or replaces) the ``vg_*`` temporary SQL functions in the session."""
    for name, (args, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return sorted(SQL_FUNCTIONS)
