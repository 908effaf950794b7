"""Source profiles: how an empty result, a NULL and text are turned into a number.

Sources disagree on these edge rules, so each spec may name a profile in
``params['profile']``. An unnamed profile reads floats and leaves empty and NULL
results unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.numbers import parse_double, parse_int, truncate_int

# Profile -> (empty result reads as 0, NULL reads as 0, integer coercion).
PROFILES = {
    "postgres": (False, False, False),
    "timescaledb": (False, False, False),
    "mssql": (False, False, False),
    "neo4j": (False, False, False),
    "oracle": (False, False, False),
    "cassandra": (False, False, False),
    "duckdb": (True, False, False),
    "cockroachdb": (True, False, True),
    "snowflake": (True, False, True),
    "trino": (True, False, True),
    "clickhouse": (True, False, True),
    "hive": (True, True, True),
    "mysql": (True, False, False),
    "bigquery": (True, False, False),
    "couchdb": (True, False, False),
    "elasticsearch": (True, False, False),
    "opensearch": (True, False, False),
    "rabbitmq": (True, False, False),
    "sqs": (True, False, True),
    "solr": (False, False, False),
    "redis": (False, False, True),
    "datadog": (False, False, False),
    "cloudwatch": (False, False, False),
    "prometheus": (False, False, False),
    "influxdb": (False, False, False),
    "kafka": (False, False, True),
    "kinesis": (False, False, True),
    "azure_eventhub": (True, False, True),
    "mongodb": (True, False, False),
    "dynamodb": (True, False, False),
    "celery": (True, False, True),
    "mqtt": (True, False, True),
}


def _flag(profile: Column, index: int) -> Column:
    names = [name for name, flags in PROFILES.items() if flags[index]]
    return F.coalesce(profile.isin(*names), F.lit(False))


def empty_as_zero(profile: Column) -> Column:
    return _flag(profile, 0)


def null_as_zero(profile: Column) -> Column:
    return _flag(profile, 1)


def int_coercion(profile: Column) -> Column:
    return _flag(profile, 2)


def coerce(value: Column, raw: Column, present: Column, profile: Column) -> tuple[Column, Column]:
    """(number, reason). ``number`` is NULL when the check must be unknown and
    ``reason`` then says why: 'no data', 'null value' or 'non-numeric'."""
    has_row = F.coalesce(present, F.lit(False))
    is_null = value.isNull() & raw.isNull()
    as_int = int_coercion(profile)
    from_value = F.when(as_int, truncate_int(value)).otherwise(value)
    from_raw = F.when(as_int, parse_int(raw)).otherwise(parse_double(raw))
    parsed = F.coalesce(from_value, from_raw)
    number = (
        F.when(~has_row, F.when(empty_as_zero(profile), F.lit(0.0)))
        .when(is_null, F.when(null_as_zero(profile), F.lit(0.0)))
        .otherwise(parsed)
    )
    reason = (
        F.when(number.isNotNull(), F.lit(None).cast("string"))
        .when(~has_row, F.lit("no data"))
        .when(is_null, F.lit("null value"))
        .otherwise(F.lit("non-numeric"))
    )
    return number, reason
