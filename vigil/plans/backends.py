"""Presets: what a source kind's name stands for in a config (check, comparison, profile, settings).

A config that names its source (``backend: mysql``) needs neither check nor comparison: the
preset gives both, the profile of its edge rules, the setting that names a pipeline's data, the
settings without which a pipeline is unknown, and what the source calls the spec's bounds.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Preset:
    check: str
    op: str
    key: str | None = None                 # setting that names the data; None: the pipeline's own name
    required: tuple[str, ...] = ()
    threshold: float | None = None         # where it is not the comparison's own default
    bounds: Mapping[str, str] = field(default_factory=dict)  # setting -> spec field
    params: Mapping[str, str] = field(default_factory=dict)


# The check, comparison and settings of each source kind.
PRESETS = {
    "airflow": Preset("latest_run", "state_airflow"),
    "azure_blob": Preset("object_count", "ge", "container", ("container",)),
    "azure_eventhub": Preset("total_lag_received", "le", "eventhub_name", bounds={"max_lag": "threshold"}),
    "azure_servicebus": Preset("backlog", "le", "queue_name", ("queue_name",)),
    "bigquery": Preset("row_count", "ge", "table"),
    "cassandra": Preset("sql_scalar", "ge", None, ("query",)),
    "celery": Preset("active_tasks", "between", "queue", ("queue",), 0.0, {"min_active": "threshold", "max_active": "max_threshold"}),
    "clickhouse": Preset("sql_scalar", "ge", None, ("query",)),
    "cloudwatch": Preset("windowed_stat", "ge", "metric_name", ("namespace", "metric_name")),
    "cockroachdb": Preset("sql_scalar", "ge", None, ("query",)),
    "couchdb": Preset("view_count", "ge", "database", ("database",)),
    "databricks": Preset("latest_run", "state_databricks", "job_id", ("job_id",)),
    "datadog": Preset("latest_point", "ge", "query", ("query",)),
    "dbt": Preset("latest_run", "state_dbt", "job_id", ("job_id",)),
    "duckdb": Preset("sql_scalar", "ge", None, ("query",)),
    "dummy": Preset("static_status", "static"),
    "dynamodb": Preset("paged_count", "ge", "table", ("table",)),
    "elasticsearch": Preset("index_count", "ge", "index"),
    "ftp": Preset("file_count", "ge", "directory"),
    "gcs": Preset("object_count", "ge", "bucket", ("bucket",)),
    "graphql": Preset("json_number", "ge", "query", ("query",)),
    "grpc": Preset("state_code", "eq", "service", params={"expected": "1"}),
    "hive": Preset("sql_scalar", "ge", None, ("query",)),
    "http": Preset("probe_status", "http", "url", ("url",), bounds={"expected_status": "expected"}),
    "influxdb": Preset("last_row_value", "ge", "query", ("query",)),
    "kafka": Preset("total_lag", "le", "topic", ("group_id", "topic"), bounds={"max_lag": "threshold"}),
    "kinesis": Preset("max_lag_ms", "le", "stream_name", (), 60_000.0, {"max_lag_ms": "threshold"}),
    "mongodb": Preset("doc_count", "ge", "collection", params={"zero_is_unset": "true"}),
    "mqtt": Preset("messages_in_window", "gt", "topic", ("broker", "topic")),
    "mssql": Preset("sql_scalar", "ge", None, ("query",)),
    "mysql": Preset("row_count", "ge", "table"),
    "nats": Preset("backlog", "le", "stream", ("stream", "consumer")),
    "neo4j": Preset("sql_scalar", "ge", None, ("query",)),
    "newrelic": Preset("first_value", "ge", "nrql", ("nrql",)),
    "opensearch": Preset("index_count", "ge", "index", ("index",)),
    "oracle": Preset("sql_scalar", "ge", None, ("query",)),
    "postgres": Preset("sql_scalar", "ge", None, ("query",)),
    "prometheus": Preset("instant_vector", "gt"),
    "pubsub": Preset("backlog", "le_any", "subscription", ("subscription",)),
    "rabbitmq": Preset("queue_depth", "ge", "queue", ("queue",)),
    "redis": Preset("kv_value", "ge", "key", ("key",)),
    "s3": Preset("recent_objects", "count_recent", "bucket", ("bucket",)),
    "sftp": Preset("file_count", "ge", "path"),
    "snowflake": Preset("sql_scalar", "ge", None, ("query",)),
    "solr": Preset("text_match_count", "ge", "collection", ("collection",)),
    "spark": Preset("latest_attempt", "completed", "app_name"),
    "splunk": Preset("first_line_field", "ge", "query", ("query",)),
    "sqs": Preset("queue_depth", "ge", "queue_url", ("queue_url",)),
    "tableau": Preset("age_hours", "max_age", "datasource_id", ("datasource_id",)),
    "timescaledb": Preset("sql_scalar", "ge", None, ("query",)),
    "trino": Preset("sql_scalar", "ge", None, ("query",)),
}

# Settings a source may give for all its pipelines, besides its keys and bounds (credentials are none of them).
SOURCE_SETTINGS = ("where", "json_path", "field", "field_path", "stat", "period", "prefix", "pattern", "label", "broker", "group_id",
                   "consumer", "namespace", "default_status")
BOUNDS = ("op", "threshold", "max_threshold", "max_age_hours", "expected")


def get_preset(name: str | None) -> Preset | None:
    """The preset of a source kind (case-insensitive); None for a name that is a check's."""
    return PRESETS.get((name or "").lower())


def preset_row(backend: str, preset: Preset, pipeline: Mapping, options: Mapping) -> dict:
    """One pipeline of a config as a spec row: its own settings, else the source's, else the
    preset's. A required setting that neither gives is named in ``params['missing_setting']``."""
    names = {*SOURCE_SETTINGS, *BOUNDS, *preset.bounds, *preset.required, *([preset.key] if preset.key else [])} - {"threshold"}
    own = {k: v for k, v in pipeline.items() if v is not None}
    merged = {**{k: v for k, v in options.items() if k in names and v is not None}, **own}
    row = {"check": preset.check, "op": preset.op}
    for setting, spec_field in preset.bounds.items():
        if setting in merged:
            merged.setdefault(spec_field, merged.pop(setting))
    params = {"profile": backend, **preset.params}
    if "expected" in params:
        row["expected"] = params.pop("expected")
    for k, v in merged.items():
        if k in BOUNDS:
            row[k] = v
        else:
            params[k] = v
    if preset.key and params.get(preset.key) not in (None, ""):
        params["key"] = params[preset.key]
    if lacking := [r for r in preset.required if params.get(r) in (None, "")]:
        params["missing_setting"] = lacking[0]
    row["params"] = params
    return row
