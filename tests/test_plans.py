"""Specs, reports, alert routing and registries."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import AS_OF
from vigil.plans.alerts import route_alerts
from vigil.plans.evaluate import evaluate, result_line
from vigil.plans.registry import get_check, get_renderer, register_check, register_renderer
from vigil.plans.report import run_report, summary_text, tag_report
from vigil.plans.specs import specs_frame, specs_from_json
from vigil.schema import MEASURES


def results(spark):
    m = spark.createDataFrame([("etl_daily", "c", 5.0, None, None, None, None, True),
                               ("etl_hourly", "c", 0.0, None, None, None, None, True)], MEASURES)
    specs = specs_frame(spark, [{"pipeline": "etl_daily", "check": "c", "tags": ["etl", "prod"]},
                                {"pipeline": "etl_hourly", "check": "c", "tags": ["etl"]},
                                {"pipeline": "quiet", "check": "c", "alert_on_failure": False}])
    return evaluate(specs, m, as_of=AS_OF)


def test_specs_from_json_defaults_and_params(spark):
    df = spark.createDataFrame([('{"name": "daily_sales", "schedule": "0 6 * * *", "max_duration_seconds": 3600, '
                                 '"alert_on_failure": true, "tags": ["finance", "daily"], "table": "sales", "min": 3}',),
                                ('{"name": "user_sync", "alert_on_failure": false}',)], "config string")
    s = {r["pipeline"]: r for r in specs_from_json(df).collect()}
    assert s["daily_sales"]["schedule"] == "0 6 * * *"
    assert s["daily_sales"]["max_duration_seconds"] == 3600
    assert s["daily_sales"]["tags"] == ["finance", "daily"]
    assert s["daily_sales"]["params"] == {"table": "sales", "min": "3"}
    assert s["user_sync"]["alert_on_failure"] is False
    assert s["user_sync"]["tags"] == [] and s["user_sync"]["schedule"] is None


def test_report_and_summary(spark):
    r = results(spark)
    ob = route_alerts(r, [{"type": "log"}, {"type": "slack"}])
    rep = run_report(r, ob).select("*", summary_text().alias("summary")).collect()[0]
    assert (rep["total"], rep["healthy"], rep["unhealthy"], rep["alerts_sent"], rep["exit_code"]) == (3, 1, 2, 2, 1)
    assert rep["summary"] == "Checked 3 pipeline(s): 1 healthy, 2 unhealthy. Alerts sent: 2."
    assert rep["total"] == rep["healthy"] + rep["unhealthy"]


def test_result_line(spark):
    line = {x["pipeline"]: x["l"] for x in results(spark).select("pipeline", result_line(results(spark)).alias("l")).collect()}
    assert line["etl_daily"] == "[OK] etl_daily (last_run=N/A): c 5 meets threshold 1"


def test_tag_report_rollup(spark):
    rep = {(x["tag"], x["status"], x["level"]): x["n"] for x in tag_report(results(spark)).collect()}
    assert rep[("etl", "ok", 0)] == 1 and rep[("etl", "critical", 0)] == 1
    assert rep[(None, None, 3)] == 4          # grand total over exploded tags (untagged counts once)


def test_alert_routing_rules(spark):
    r = results(spark)
    ob = route_alerts(r, [{"type": "sms", "recipients": ["+15559990000", "+15558880000"]},
                          {"type": "webhook"}, {"type": "webhook", "name": "all", "only_failures": False}],
                      alert_on_healthy=True).collect()
    sms = [(o["recipient"], o["pipeline"]) for o in ob if o["channel"] == "sms"]
    assert sorted(sms) == [("+15558880000", "etl_hourly"), ("+15559990000", "etl_hourly")]
    assert sorted(o["pipeline"] for o in ob if o["channel"] == "webhook") == ["etl_hourly"]
    assert sorted(o["pipeline"] for o in ob if o["channel"] == "all") == ["etl_daily", "etl_hourly"]
    assert all(o["pipeline"] != "quiet" for o in ob)   # alert_on_failure = false


def test_opsgenie_and_slack_payloads(spark):
    r = results(spark)
    ob = route_alerts(r, [{"type": "opsgenie", "params": {"priority": "P2", "tags": ["etl", "prod"]}}, {"type": "slack"}],
                      alert_on_healthy=True).collect()
    og = {o["pipeline"]: json.loads(o["payload"]) for o in ob if o["channel"] == "opsgenie"}
    assert og["etl_hourly"]["priority"] == "P2" and "action" not in og["etl_hourly"]
    assert og["etl_daily"]["priority"] == "P5" and og["etl_daily"]["action"] == "close"
    assert og["etl_daily"]["alias"] == "vigil-etl_daily-c" and og["etl_daily"]["tags"] == ["etl", "prod"]
    sl = {o["pipeline"]: json.loads(o["payload"]) for o in ob if o["channel"] == "slack"}
    assert sl["etl_daily"]["text"].startswith(":white_check_mark: Pipeline: etl_daily\nStatus:   OK\nDetails:  ")
    assert sl["etl_hourly"]["text"].startswith(":red_circle: ")


def test_registries(spark):
    register_check("My_Check", lambda df, key: df)
    assert get_check("my_check") is get_check("MY_CHECK")
    with pytest.raises(KeyError, match="Known checks: .*row_count"):
        get_check("nope")
    from vigil import operators as M
    assert get_check("Row_Count") is M.row_count
    first = register_renderer("custom_x", lambda ctx: F.lit("a"))
    second = register_renderer("custom_x", lambda ctx: F.lit("b"))
    assert get_renderer("custom_x") is second and first is not second
    with pytest.raises(KeyError, match="no renderer is registered"):
        get_renderer("pigeon")


def test_run_checks_rerun_is_idempotent(spark):
    from vigil.plans.runner import run_checks
    from vigil.session import scratch_path
    m = spark.createDataFrame([("etl_daily", "c", 5.0, None, None, None, None, True),
                               ("etl_hourly", "c", 0.0, None, None, None, None, True)], MEASURES)
    specs = specs_frame(spark, [{"pipeline": "etl_daily", "check": "c"}, {"pipeline": "etl_hourly", "check": "c"}])
    path = scratch_path(spark, "run-outbox")
    for _ in range(2):
        run = run_checks(specs, m, [{"type": "log"}, {"type": "slack"}], as_of=AS_OF, outbox_path=path)
    rep = run.report.collect()[0]
    assert (rep["total"], rep["unhealthy"], rep["alerts_sent"]) == (2, 1, 2)
    assert spark.read.json(path).count() == 2


def test_jdbc_source_argument_checks(spark):
    from vigil.sources import jdbc_source
    with pytest.raises(ValueError, match="exactly one"):
        jdbc_source(spark, "jdbc:postgresql://db/x")
    with pytest.raises(ValueError, match="exactly one"):
        jdbc_source(spark, "jdbc:postgresql://db/x", query="select 1", table="t")
    with pytest.raises(ValueError, match="partitioned reads"):
        jdbc_source(spark, "jdbc:postgresql://db/x", table="t", partition_column="id")


def test_config_frames(spark):
    from vigil.plans.specs import config_frames
    cfg = config_frames(spark, {
        "backend": "row_count", "backend_options": {"db_path": "/tmp/x.db", "threshold": 5},
        "alert_channels": ["slack", {"type": "sms", "recipients": ["+1"]}],
        "pipelines": [{"name": "daily_sales", "schedule": "0 6 * * *", "max_duration_seconds": 3600,
                       "alert_on_failure": True, "tags": ["finance", "daily"], "table": "sales"},
                      {"name": "user_sync", "alert_on_failure": False}]})
    s = {r["pipeline"]: r for r in cfg.specs.collect()}
    assert s["daily_sales"]["check"] == "row_count" and s["daily_sales"]["op"] == "ge"
    assert s["daily_sales"]["schedule"] == "0 6 * * *" and s["daily_sales"]["max_duration_seconds"] == 3600
    assert s["daily_sales"]["tags"] == ["finance", "daily"] and s["daily_sales"]["params"] == {"table": "sales"}
    assert s["user_sync"]["alert_on_failure"] is False and s["user_sync"]["tags"] == []
    assert cfg.channels == [{"type": "slack"}, {"type": "sms", "recipients": ["+1"]}]
    assert cfg.defaults == {"row_count": 5.0}
    empty = config_frames(spark, {})
    assert empty.specs.count() == 0 and empty.channels == []
    assert route_alerts(results(spark), empty.channels).count() == 0


def test_two_checks_of_a_pipeline_are_two_incidents(spark):
    m = spark.createDataFrame([("p", "a", 0.0, None, None, None, None, True)], MEASURES)
    r = evaluate(specs_frame(spark, [{"pipeline": "p", "check": "a"}, {"pipeline": "p", "check": "b"}]), m, as_of=AS_OF)
    ob = route_alerts(r, [{"type": "opsgenie"}, {"type": "victorops"}]).collect()
    assert {o["dedup_key"] for o in ob} == {"vigil-p-a", "vigil-p-b"}
    assert {json.loads(o["payload"]).get("alias") for o in ob} - {None} == {"vigil-p-a", "vigil-p-b"}
    assert {json.loads(o["payload"]).get("entity_id") for o in ob} - {None} == {"vigil.p.a", "vigil.p.b"}


def test_settings_bind_specs_to_data(spark):
    from vigil.operators import bind
    m = spark.createDataFrame([("emails", "active_tasks", 1.0, None, None, None, None, True)], MEASURES)
    specs = specs_frame(spark, [
        {"pipeline": "nightly-mail", "check": "active_tasks", "threshold": 0, "max_threshold": 0, "queue": "emails", "profile": "celery"},
        {"pipeline": "emails", "check": "active_tasks", "threshold": 0, "max_threshold": 0, "profile": "celery"},
        {"pipeline": "idle", "check": "active_tasks", "threshold": 0, "max_threshold": 0, "queue": "none", "profile": "celery"},
        {"pipeline": "blank", "check": "active_tasks", "threshold": 0, "max_threshold": 0, "queue": "", "profile": "celery"}])

    def statuses(**kw):
        return {r["pipeline"]: (r["status"], r["value"]) for r in evaluate(specs, bind(specs, m, **kw), as_of=AS_OF).collect()}
    # the profile requires a queue: without one a pipeline is unknown, whatever lies under its name
    known = {"nightly-mail": ("critical", 1.0), "emails": ("unknown", None), "idle": ("ok", 0.0), "blank": ("unknown", None)}
    assert statuses() == known and statuses(required=["active_tasks"]) == known


def test_run_from_a_config(spark):
    from vigil.plans.runner import run_config
    messages = spark.createDataFrame([("orders", 1), ("orders", 2), ("mail", 3)], "q string, id int")
    config = {"backend": "queue_depth", "alert_channels": ["log"], "pipelines": [
        {"name": "nightly", "queue": "orders", "threshold": 2}, {"name": "mail", "threshold": 5},
        {"name": "gone", "check": "row_count", "threshold": 1, "profile": "mysql"}]}
    sources = {"queue_depth": {"df": messages, "key": "q"}, "row_count": {"df": messages, "key": "no_such_column"}}
    run = run_config(spark, config, sources, as_of=AS_OF)
    assert {r["pipeline"]: r["status"] for r in run.results.collect()} == {"nightly": "ok", "mail": "critical", "gone": "unknown"}
    assert {r["pipeline"] for r in run.outbox.collect()} == {"mail", "gone"}
    with pytest.raises(KeyError, match="rowcount"):
        run_config(spark, {"pipelines": [{"name": "p", "check": "rowcount"}]}, sources)
    with pytest.raises(KeyError, match="no source"):
        run_config(spark, {"pipelines": [{"name": "p", "check": "total_lag"}]}, sources)
