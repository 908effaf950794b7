"""Spec rows with defaults; settings outside the known columns go to ``params``."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.plans.backends import BOUNDS, SOURCE_SETTINGS, get_preset, preset_row
from vigil.schema import SPECS

KNOWN_KEYS = ("name", "pipeline", "check", "op", "threshold", "max_threshold", "max_age_hours", "expected",
              "schedule", "max_duration_seconds", "alert_on_failure", "tags")

# The comparison each built-in check uses when a spec names none.
DEFAULT_OP = {
    "row_count": "ge", "sql_scalar": "ge", "doc_count": "ge", "index_count": "ge", "text_match_count": "ge",
    "paged_count": "ge", "view_count": "ge", "kv_value": "ge", "latest_point": "ge", "windowed_stat": "ge",
    "instant_vector": "gt", "first_value": "ge", "first_line_field": "ge", "last_row_value": "ge",
    "total_lag": "le", "total_lag_received": "le", "max_lag_ms": "le", "backlog": "le",
    "queue_depth": "ge", "active_tasks": "between", "messages_in_window": "gt", "object_count": "ge",
    "file_count": "ge", "recent_objects": "count_recent", "age_hours": "max_age", "latest_run": "state_airflow",
    "latest_attempt": "completed", "json_number": "ge", "json_truthy": "truthy", "state_code": "eq",
    "probe_status": "http", "static_status": "static",
}


_DEFAULT_OP_EXPR: dict = {}


def default_op(check: Column | None = None) -> Column:
    """The default comparison of a check name, as one map lookup. For the plain
    ``check`` column the expression is built once per JVM and reused."""
    if check is not None:
        return F.element_at(_op_map(), check)
    from pyspark import SparkContext
    key = id(SparkContext._gateway)
    if key not in _DEFAULT_OP_EXPR:
        _DEFAULT_OP_EXPR[key] = F.element_at(_op_map(), F.col("check"))
    return _DEFAULT_OP_EXPR[key]


def _op_map() -> Column:
    items = []
    for name, op in DEFAULT_OP.items():
        items += [F.lit(name), F.lit(op)]
    return F.create_map(*items)


def normalize_specs(df: DataFrame) -> DataFrame:
    """Fill every SPECS column (missing ones NULL), apply defaults, keep SPECS order
    (one projection)."""
    cols = set(df.columns)

    def field(name):
        c = F.col(name) if name in cols else F.lit(None)
        return c.cast(SPECS[name].dataType)

    defaults = {
        "op": F.coalesce(field("op"), F.element_at(_op_map(), field("check")), F.lit("ge")),
        "alert_on_failure": F.coalesce(field("alert_on_failure"), F.lit(True)),
        "tags": F.coalesce(field("tags"), F.array().cast("array<string>")),
        "params": F.coalesce(field("params"), F.create_map().cast("map<string,string>")),
    }
    return df.select(*[defaults.get(f, field(f)).alias(f) for f in SPECS.fieldNames()])


def _text(value) -> str | None:
    """A setting as text, as a JSON config gives it: true, not True."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value) if isinstance(value, (bool, list, tuple, dict)) else str(value)


def specs_frame(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Specs from a short list of dicts (a config file's pipelines). The rows
    become an inline table (a local relation in the JVM, no Python workers)."""
    known = set(SPECS.fieldNames())
    data = []
    for r in rows:
        r = dict(r)
        if "name" in r and "pipeline" not in r:
            r["pipeline"] = r.pop("name")
        params = dict(r.get("params") or {})
        for k in list(r):
            if k not in known:
                params[k] = r.pop(k)
        r["params"] = {str(k): _text(v) for k, v in params.items()}
        for f in ("threshold", "max_threshold", "max_age_hours"):
            if r.get(f) is not None:
                r[f] = float(r[f])
        if r.get("expected") is not None:
            r["expected"] = str(r["expected"])
        data.append(r)
    if not data:
        return normalize_specs(spark.createDataFrame([], SPECS))
    body = ", ".join("(" + ", ".join(_sql_literal(r.get(f.name), f.dataType) for f in SPECS.fields) + ")"
                     for r in data)
    names = ", ".join(f"`{f}`" for f in SPECS.fieldNames())
    return normalize_specs(spark.sql(f"SELECT * FROM VALUES {body} AS t({names})"))


def _sql_string(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_literal(v, dtype) -> str:
    """A typed SQL literal for one SPECS field value."""
    type_sql = dtype.simpleString()
    if v is None:
        return f"CAST(NULL AS {type_sql})"
    if isinstance(dtype, T.StringType):
        return _sql_string(str(v))
    if isinstance(dtype, T.BooleanType):
        return "TRUE" if v else "FALSE"
    if isinstance(dtype, (T.DoubleType, T.IntegerType)):
        x = float(v) if isinstance(dtype, T.DoubleType) else int(v)
        if isinstance(x, float) and x != x:
            return "CAST('NaN' AS DOUBLE)"
        if isinstance(x, float) and x in (float("inf"), float("-inf")):
            return "CAST('Infinity' AS DOUBLE)" if x > 0 else "CAST('-Infinity' AS DOUBLE)"
        return f"CAST({x!r} AS {type_sql})"
    if isinstance(dtype, T.ArrayType):
        items = ", ".join(_sql_string(str(x)) for x in v)
        return f"CAST(array({items}) AS {type_sql})"
    if isinstance(dtype, T.MapType):
        items = ", ".join(f"{_sql_string(str(k))}, {'CAST(NULL AS STRING)' if x is None else _sql_string(str(x))}"
                          for k, x in v.items())
        return f"CAST(map({items}) AS {type_sql})"
    raise TypeError(f"unsupported spec field type {type_sql}")


def specs_from_json(df: DataFrame, text: str | Column = "config") -> DataFrame:
    """Specs from one JSON object per row (``{"name": ..., "threshold": ..., ...}``);
    unknown keys become ``params`` (values as JSON text, strings unquoted)."""
    t = F.col(text) if isinstance(text, str) else text
    known = F.from_json(
        t,
        "name string, pipeline string, check string, op string, threshold double, max_threshold double, "
        "max_age_hours double, expected string, schedule string, max_duration_seconds int, "
        "alert_on_failure boolean, tags array<string>",
    )
    every = F.from_json(t, "map<string,string>")
    known_keys = F.array(*[F.lit(k) for k in KNOWN_KEYS])
    params = F.map_filter(every, lambda k, v: ~F.array_contains(known_keys, k))
    return normalize_specs(df.select(
        F.coalesce(known["pipeline"], known["name"]).alias("pipeline"),
        known["check"].alias("check"), known["op"].alias("op"), known["threshold"].alias("threshold"),
        known["max_threshold"].alias("max_threshold"), known["max_age_hours"].alias("max_age_hours"),
        known["expected"].alias("expected"), known["schedule"].alias("schedule"),
        known["max_duration_seconds"].alias("max_duration_seconds"),
        known["alert_on_failure"].alias("alert_on_failure"), known["tags"].alias("tags"),
        params.alias("params"),
    ))


@dataclass
class Config:
    """A parsed config mapping as Spark inputs: the specs, the alert channels
    (a short list of dicts for ``route_alerts``) and per-check default
    thresholds (the source-level step of the threshold chain, V15)."""
    specs: DataFrame
    channels: list
    defaults: dict


PIPELINE_KEYS = ("name", "schedule", "max_duration_seconds", "alert_on_failure", "tags")


def config_frames(spark: SparkSession, config: Mapping) -> Config:
    """E1 from an already-parsed config mapping (``backend``, ``backend_options``,
    ``alert_channels``, ``pipelines``). Each pipeline becomes one spec. Its check is its own
    ``check`` key, else what the backend's preset stands for (``backends.PRESETS``), else the
    backend name itself. Every other key lands in ``params``. ``backend_options`` are the settings of
    all pipelines that don't set their own: bounds, comparison and data settings; its ``threshold``
    becomes the default of the check (V15). Numbers may come as text. Channels may be given as type
    names or dicts."""
    backend = config.get("backend")
    options = dict(config.get("backend_options") or {})
    preset = get_preset(backend)
    rows = []
    for p in config.get("pipelines") or []:
        p = dict(p)
        row = {k: p.pop(k) for k in PIPELINE_KEYS if k in p}
        check = p.pop("check", None)
        if check is None and preset:
            rows.append({**row, **preset_row(backend.lower(), preset, p, options)})
            continue
        row["check"] = check or backend
        shared = options if row["check"] == backend else {}
        for k in BOUNDS:
            if k in p:
                row[k] = p.pop(k)
            elif k != "threshold" and shared.get(k) is not None:
                row[k] = shared[k]
        row["params"] = {**{k: v for k, v in shared.items() if k in SOURCE_SETTINGS}, **p}
        rows.append(row)
    if rows:
        specs = specs_frame(spark, rows)
    else:
        specs = normalize_specs(spark.createDataFrame([], SPECS))
    channels = [{"type": c} if isinstance(c, str) else dict(c) for c in config.get("alert_channels") or []]
    defaults = {}
    names = [n for n, to in (preset.bounds.items() if preset else ()) if to == "threshold"]
    given = next((x for x in (_number(options.get(n)) for n in ["threshold", *names]) if x is not None), preset.threshold if preset else None)
    if backend and given is not None:
        defaults[preset.check if preset else backend] = given
    return Config(specs=specs, channels=channels, defaults=defaults)


def _number(value) -> float | None:
    """A setting as a number; None for what is none (a truth value included)."""
    try:
        return None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None
