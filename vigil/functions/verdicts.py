"""Verdicts: status columns from a measured value and the spec's settings.

Each ``verdict_*`` returns a status column (ok / critical / unknown / warning).
Numeric verdicts treat NULL as unknown and NaN as critical (Spark orders NaN above
every number, so ``NaN >= t`` would otherwise be true).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.status import CRITICAL, OK, UNKNOWN, normalize_status

# Default thresholds per comparison.
DEFAULT_THRESHOLD = {
    "ge": 1.0,
    "gt": 0.0,
    "le": 0.0,
    "le_any": 0.0,
    "between": 0.0,
    "max_age": 24.0,
    "count_recent": 1.0,
    "eq": None,
    "http": 200.0,
}

# Run-state maps of three schedulers.
AIRFLOW_STATES = {"success": OK, "failed": CRITICAL, "upstream_failed": CRITICAL, "skipped": CRITICAL}
DBT_STATES = {"Success": OK, "Error": CRITICAL, "Cancelled": CRITICAL}
DATABRICKS_TERMINAL = "TERMINATED"
DATABRICKS_RESULTS = {"SUCCESS": OK, "FAILED": CRITICAL, "TIMEDOUT": CRITICAL, "CANCELED": CRITICAL}


def _lit_map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _numeric(v: Column, healthy: Column) -> Column:
    return (
        F.when(v.isNull(), F.lit(UNKNOWN))
        .when(F.isnan(v), F.lit(CRITICAL))
        .when(healthy, F.lit(OK))
        .otherwise(F.lit(CRITICAL))
    )


def verdict_ge(v: Column, t: Column) -> Column:
    """V1: ok iff v >= t (inclusive)."""
    return _numeric(v, v >= t)


def verdict_gt(v: Column, t: Column) -> Column:
    """V2: ok iff v > t."""
    return _numeric(v, v > t)


def verdict_le(v: Column, t: Column) -> Column:
    """V3: ok iff v <= t (lag, backlog, depth upper bounds)."""
    return _numeric(v, v <= t)


def verdict_le_any(v: Column, t: Column) -> Column:
    """V4: threshold -1 accepts any reachable value; otherwise V3."""
    return _numeric(v, (t == F.lit(-1.0)) | (v <= t))


def verdict_between(v: Column, lo: Column, hi: Column) -> Column:
    """V5: below the minimum fails first, then above the maximum when one is set."""
    return _numeric(v, ~(v < lo) & ~(hi.isNotNull() & (v > hi)))


def verdict_max_age(age_hours: Column, max_hours: Column) -> Column:
    """V6: ok iff age <= max hours (inclusive)."""
    return _numeric(age_hours, age_hours <= max_hours)


def verdict_count_recent(count: Column, t: Column, newest_age_hours: Column, max_hours: Column) -> Column:
    """V7: the count must meet the threshold; then, when a max age is set, the
    newest object must be at most that old (modified at or after the cutoff)."""
    recent = F.coalesce(newest_age_hours <= max_hours, F.lit(False))
    return _numeric(count, (count >= t) & (max_hours.isNull() | recent))


def verdict_eq(v: Column, expected: Column) -> Column:
    """Equal ok, else critical."""
    return _numeric(v, v == expected)


def verdict_state_airflow(state: Column) -> Column:
    """V8: lower-cased state through the map; anything else unknown."""
    return F.coalesce(F.element_at(_lit_map(AIRFLOW_STATES), F.lower(state)), F.lit(UNKNOWN))


def verdict_state_dbt(state: Column) -> Column:
    """V9: case-sensitive state map; anything else unknown."""
    return F.coalesce(F.element_at(_lit_map(DBT_STATES), state), F.lit(UNKNOWN))


def verdict_state_databricks(life_cycle: Column, result: Column) -> Column:
    """Not terminated is unknown; then the result state through the map."""
    mapped = F.coalesce(F.element_at(_lit_map(DATABRICKS_RESULTS), result), F.lit(UNKNOWN))
    return F.when(F.coalesce(life_cycle == F.lit(DATABRICKS_TERMINAL), F.lit(False)), mapped).otherwise(F.lit(UNKNOWN))


def verdict_completed(completed: Column, duration: Column) -> Column:
    """Not completed unknown; completed with duration > 0 ok; else critical."""
    return (
        F.when(~F.coalesce(completed, F.lit(False)), F.lit(UNKNOWN))
        .when(F.coalesce(duration > F.lit(0.0), F.lit(False)), F.lit(OK))
        .otherwise(F.lit(CRITICAL))
    )


def verdict_truthy(truthiness: Column) -> Column:
    """V13: 'truthy' ok, 'falsy' critical, missing path unknown."""
    return (
        F.when(truthiness == F.lit("truthy"), F.lit(OK))
        .when(truthiness == F.lit("falsy"), F.lit(CRITICAL))
        .otherwise(F.lit(UNKNOWN))
    )


def verdict_http(code: Column, expected: Column, truthiness: Column, has_path: Column) -> Column:
    """V12 then V13: the status code is tested before the body."""
    return (
        F.when(code.isNull(), F.lit(UNKNOWN))
        .when(code != expected, F.lit(CRITICAL))
        .when(has_path, verdict_truthy(truthiness))
        .otherwise(F.lit(OK))
    )


def verdict_static(present: Column, override: Column, default: Column) -> Column:
    """The override word when given, else the default; unknown words unknown."""
    return F.when(F.coalesce(present, F.lit(False)), normalize_status(override)).otherwise(normalize_status(default))


def threshold_chain(spec_threshold: Column, source_default: Column, op_default: Column, zero_is_unset: Column | None = None) -> Column:
    """Pipeline setting, else source setting, else constant. With
    ``zero_is_unset`` a 0 setting counts as unset."""
    own = spec_threshold
    if zero_is_unset is not None:
        own = F.when(zero_is_unset & (spec_threshold == F.lit(0.0)), F.lit(None).cast("double")).otherwise(spec_threshold)
    return F.coalesce(own, source_default, op_default)
