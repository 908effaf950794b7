"""Column functions: statuses, numbers, JSON paths, globs, verdicts, profiles."""

from vigil.functions.globs import base_name, glob_match, glob_regex
from vigil.functions.jsonpath import json_has, json_number, json_path, json_truthiness, json_value
from vigil.functions.numbers import num_text, parse_double, parse_int, truncate_int
from vigil.functions.status import CRITICAL, OK, STATUSES, UNKNOWN, WARNING, is_healthy, normalize_status
from vigil.functions.verdicts import (threshold_chain, verdict_between, verdict_completed, verdict_count_recent,
                                      verdict_eq, verdict_ge, verdict_gt, verdict_http, verdict_le, verdict_le_any,
                                      verdict_max_age, verdict_state_airflow, verdict_state_databricks,
                                      verdict_state_dbt, verdict_static, verdict_truthy)

__all__ = [
    "OK", "WARNING", "CRITICAL", "UNKNOWN", "STATUSES", "is_healthy", "normalize_status", "num_text",
    "parse_double", "parse_int", "truncate_int", "json_path", "json_value", "json_has", "json_number",
    "json_truthiness", "glob_regex", "glob_match", "base_name", "verdict_ge", "verdict_gt", "verdict_le",
    "verdict_le_any", "verdict_between", "verdict_max_age", "verdict_count_recent", "verdict_eq",
    "verdict_state_airflow", "verdict_state_dbt", "verdict_state_databricks", "verdict_completed",
    "verdict_truthy", "verdict_http", "verdict_static", "threshold_chain",
]
