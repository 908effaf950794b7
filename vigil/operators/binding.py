"""Binding of specs to the data they measure.

Measures are keyed by what the data calls a queue, topic or table. A spec may name that
key in a setting, its pipeline name then being only a label; ``bind`` gives the measures
the pipeline names of the specs that watch them. Only aggregated rows are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.schema import MEASURES, MISSING_SETTING

# The setting that names what a check measures.
KEY_SETTING = {
    "active_tasks": "queue", "queue_depth": "queue", "backlog": "queue", "total_lag": "topic",
    "total_lag_received": "topic", "messages_in_window": "topic", "max_lag_ms": "stream_name",
    "row_count": "table", "index_count": "index", "latest_attempt": "app_name",
}


# Without this setting a spec of the profile is unknown, whatever the data holds.
REQUIRED_BY_PROFILE = {"celery": "queue", "rabbitmq": "queue", "azure_servicebus": "queue_name", "kafka": "topic", "mqtt": "topic",
                       "sqs": "queue_url", "opensearch": "index", "tableau": "datasource_id", "redis": "key", "pubsub": "subscription",
                       "nats": "stream", "dynamodb": "table", "couchdb": "database", "databricks": "job_id", "dbt": "job_id"}


def _lacking() -> Column:
    """The required setting a spec lacks: what its config found missing, else its profile's; NULL if none."""
    needed = F.element_at(F.create_map(*[F.lit(x) for pair in REQUIRED_BY_PROFILE.items() for x in pair]), F.element_at("params", F.lit("profile")))
    unset = F.coalesce(F.element_at("params", needed), F.lit("")) == ""
    return F.coalesce(F.element_at("params", F.lit("missing_setting")), F.when(needed.isNotNull() & unset, needed))


def _setting(settings: Mapping[str, str]) -> Column:
    """The value of the setting that names the check's key; NULL where unset or empty."""
    value = F.lit(None).cast("string")
    for check, name in settings.items():
        value = F.when(F.col("check") == F.lit(check), F.element_at("params", F.lit(name))).otherwise(value)
    preset = F.when(F.col("check") != F.lit("kv_value"), F.element_at("params", F.lit("key")))
    return F.coalesce(F.when(value != F.lit(""), value), F.when(preset != F.lit(""), preset))


def bind(specs: DataFrame, measures: DataFrame, settings: Mapping[str, str] | None = None,
         required: Iterable[str] = ()) -> DataFrame:
    """Measures keyed by pipeline. A spec's key is its setting (``settings`` over
    ``KEY_SETTING``, else ``params['key']``), or else its pipeline name; several specs may watch one key. A spec that
    lacks a setting its profile requires (``REQUIRED_BY_PROFILE``) or its config found missing is
    unknown (V14) and the pipeline name is not tried; so is, for the checks of ``required``, a spec
    without a key."""
    settings = {**KEY_SETTING, **(settings or {})}
    required = list(required)
    named = specs.select("pipeline", "check", _setting(settings).alias("_named"), _lacking().alias("_lacks"))
    if required:
        names = F.create_map(*[F.lit(x) for check in required for x in (check, settings.get(check, "key"))])
        named = named.withColumn("_lacks", F.coalesce("_lacks", F.when(F.col("_named").isNull(), F.element_at(names, F.col("check")))))
    wanted = named.where(F.col("_lacks").isNull()).select("pipeline", "check", F.coalesce("_named", "pipeline").alias("_key"))
    found = wanted.join(measures.withColumnRenamed("pipeline", "_key"), ["_key", "check"]).select(*MEASURES.fieldNames())
    lacking = named.where(F.col("_lacks").isNotNull())
    return found.unionByName(_unknown(lacking))


def _unknown(lacking: DataFrame) -> DataFrame:
    """A measure that names the missing setting for each of the specs."""
    fields = {"pipeline": F.col("pipeline"), "check": F.col("check"), "raw": F.col("_lacks"), "state": F.lit(MISSING_SETTING), "present": F.lit(True)}
    return lacking.select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MEASURES.fields])
