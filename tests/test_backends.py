"""Configs that name a source kind: presets, source-level settings, required settings, failures at run time."""

import os

import pytest
from helpers import AS_OF
from pyspark.sql import functions as F

from vigil.functions.profiles import PROFILES
from vigil.operators.binding import REQUIRED_BY_PROFILE
from vigil.plans.backends import PRESETS
from vigil.plans.evaluate import OPS
from vigil.plans.registry import known_checks
from vigil.plans.runner import run_config
from vigil.plans.specs import config_frames


def statuses(run):
    return {r["pipeline"]: r["status"] for r in run.results.collect()}


def test_presets_name_checks_and_comparisons_that_exist():
    assert len(PRESETS) == 51 and set(PROFILES) <= set(PRESETS) and set(REQUIRED_BY_PROFILE) <= set(PRESETS)
    for name, preset in PRESETS.items():
        assert preset.check in known_checks() and preset.op in OPS, name
    for name, setting in REQUIRED_BY_PROFILE.items():
        assert setting in PRESETS[name].required, name


def test_backend_name_is_a_check(spark):
    rows = spark.createDataFrame([("sales",)] * 3 + [("users",)], "t string")
    config = {"backend": "MySQL", "pipelines": [{"name": "daily", "table": "sales", "threshold": "3"}, {"name": "users"}, {"name": "none", "table": "gone"}]}
    run = run_config(spark, config, {"mysql": {"df": rows, "key": "t"}}, as_of=AS_OF)
    assert statuses(run) == {"daily": "ok", "users": "ok", "none": "critical"}


def test_source_level_settings(spark):
    updates = spark.createDataFrame([("d1", "2024-06-01T02:00:00Z"), ("d2", "2024-06-01T11:00:00Z")], "id string, at string")
    config = {"backend": "tableau", "backend_options": {"max_age_hours": 6, "token_value": "secret"}, "pipelines": [
        {"name": "a", "datasource_id": "d1"}, {"name": "b", "datasource_id": "d1", "max_age_hours": 12}, {"name": "c", "datasource_id": "d2"}, {"name": "d"}]}
    cfg = config_frames(spark, config)
    assert "secret" not in str(cfg.specs.collect())
    sources = {"age_hours": {"df": updates, "key": "id", "updated_at": "at", "as_of": F.lit(AS_OF).cast("timestamp_ntz")}}
    run = run_config(spark, config, sources, as_of=AS_OF)
    assert statuses(run) == {"a": "critical", "b": "ok", "c": "ok", "d": "unknown"}
    assert {r["pipeline"]: r["message"] for r in run.results.collect()}["d"].endswith("missing setting 'datasource_id'")


def test_bounds_by_the_source_s_own_names(spark):
    tasks = config_frames(spark, {"backend": "celery", "backend_options": {"max_active": 5}, "pipelines": [
        {"name": "a", "queue": "q", "min_active": 2}, {"name": "b", "queue": "q", "max_active": 9}, {"name": "c"}]})
    got = {r["pipeline"]: (r["check"], r["op"], r["threshold"], r["max_threshold"], r["params"].get("missing_setting")) for r in tasks.specs.collect()}
    assert got == {"a": ("active_tasks", "between", 2.0, 5.0, None), "b": ("active_tasks", "between", None, 9.0, None),
                   "c": ("active_tasks", "between", None, 5.0, "queue")}
    lag = config_frames(spark, {"backend": "kinesis", "pipelines": [{"name": "s"}]})
    assert lag.defaults == {"max_lag_ms": 60_000.0}
    assert config_frames(spark, {"backend": "kafka", "backend_options": {"max_lag": "7", "topic": "t", "group_id": "g"}, "pipelines": [{"name": "s"}]}).defaults == {"total_lag": 7.0}


def test_sql_backends_run_their_pipelines_queries(spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    config = {"backend": "postgres", "pipelines": [{"name": "ok", "query": "SELECT count(*) FROM three_rows"}, {"name": "low", "query": "SELECT count(*) FROM three_rows", "threshold": 9},
                                                   {"name": "broken", "query": "SELECT nothing FROM nowhere"}, {"name": "fails", "query": "SELECT raise_error('down')"}, {"name": "unset"}]}
    assert statuses(run_config(spark, config, {}, as_of=AS_OF)) == {"ok": "ok", "low": "critical", "broken": "unknown", "fails": "unknown", "unset": "unknown"}


def test_a_corrupt_file_and_a_failing_cast_leave_the_others_alone(spark, tmp_path):
    good = spark.createDataFrame([("a",), ("a",), ("x",)], "k string")
    folder = str(tmp_path / "rows.parquet")
    good.coalesce(1).write.parquet(folder)
    part = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    size = os.path.getsize(os.path.join(folder, part))
    for name in (part, f".{part}.crc"):
        if os.path.exists(os.path.join(folder, name)):
            os.chmod(os.path.join(folder, name), 0o644)
    with open(os.path.join(folder, part), "r+b") as f:
        f.write(b"\0" * size)
    config = {"pipelines": [{"name": "a", "check": "row_count", "threshold": 2}, {"name": "b", "check": "queue_depth"}, {"name": "c", "check": "view_count"}]}
    sources = {"row_count": {"df": good, "key": "k"}, "queue_depth": {"df": spark.read.schema("k string").parquet(folder), "key": "k"},
               "view_count": {"df": good, "key": F.col("k").cast("int")}}
    run = run_config(spark, config, sources, as_of=AS_OF)
    assert statuses(run) == {"a": "ok", "b": "unknown", "c": "unknown"}
    assert all("source error" in r["message"] for r in run.results.where("status = 'unknown'").collect())


def test_config_errors(spark):
    with pytest.raises(ValueError, match="no pipelines"):
        run_config(spark, {"backend": "mysql"}, {})
    with pytest.raises(KeyError, match="no source"):
        run_config(spark, {"backend": "mysql", "pipelines": [{"name": "a"}]}, {})
