"""Exports with broken lines (S4, S6, S7), rolled event logs, and sends per channel."""

import json

from helpers import AS_OF
from pyspark.sql import functions as F

from vigil import operators as M
from vigil.plans.alerts import route_alerts
from vigil.plans.evaluate import evaluate
from vigil.plans.report import run_report
from vigil.plans.specs import specs_frame
from vigil.schema import MEASURES
from vigil.sources import json_documents, ndjson_export, runs_from_event_log, runs_from_json
from vigil.sources.records import unless_bad

LINES = ['{"k": "a", "n": 1}', '{"k": "b", "n": 2', "", "not json", '{"k": "a", "n": "text"}', "[1, 2]", '{"k": null}', '{"n": 5, "x": {"y": 1}}', "7"]


def written(folder, lines, name="export.json"):
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)


def test_bad_lines_are_kept_apart(spark, tmp_path):
    read = json_documents(spark, written(tmp_path, LINES), "k string, n int")
    assert sorted((r["k"] or "", r["n"] or 0) for r in read.good.collect()) == [("", 0), ("", 5), ("a", 1)]
    assert sorted(r["record"] for r in read.bad.collect()) == sorted([LINES[1], LINES[3], LINES[4], LINES[5], LINES[8]])
    inferred = ndjson_export(spark, str(tmp_path))
    assert {"k", "n", "x"} <= set(inferred.good.columns) and inferred.good.count() == 4 and inferred.bad.count() == 4
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "e.json").write_text("")
    nothing = json_documents(spark, str(empty), "k string")
    assert nothing.good.count() == 0 and nothing.bad.count() == 0


def test_a_source_with_bad_lines_is_unknown(spark, tmp_path):
    specs = specs_frame(spark, [{"pipeline": p, "check": "row_count", "params": {"profile": "mysql"}} for p in ("a", "none")])
    for name, lines, want in (("bad", LINES, {"a": "unknown", "none": "unknown"}), ("good", LINES[:1], {"a": "ok", "none": "critical"})):
        folder = tmp_path / name
        folder.mkdir()
        read = json_documents(spark, written(folder, lines), "k string, n int")
        results = evaluate(specs, unless_bad(M.row_count(read.good, "k"), read.bad, specs), as_of=AS_OF).collect()
        assert {r["pipeline"]: r["status"] for r in results} == want
        if name == "bad":
            assert {r["message"] for r in results} == {"row_count: 5 bad records"}


def test_runs_with_bad_lines(spark, tmp_path):
    runs = ['{"job": "j", "id": 1, "at": "2024-01-01T00:00:00", "state": "success"}', '{"job": "j", "id": 2, "at"']
    read = runs_from_json(spark, written(tmp_path, runs), "job string, id long, at string, state string", job="job", run_id="id", started="at", state="state")
    assert [r["state"] for r in read.good.collect()] == ["success"] and read.bad.count() == 1


def test_rolled_event_logs_are_stitched(spark, tmp_path):
    def start(app, attempt, at):
        return json.dumps({"Event": "SparkListenerApplicationStart", "App Name": app, "App ID": app, "App Attempt ID": attempt, "Timestamp": at})

    def end(at):
        return json.dumps({"Event": "SparkListenerApplicationEnd", "Timestamp": at})
    other = '{"Event": "SparkListenerJobStart"}'

    def log(app, attempt, parts):
        folder = tmp_path / f"eventlog_v2_{app}_{attempt}"
        folder.mkdir()
        (folder / f"appstatus_{app}_{attempt}").write_text("")
        for n, lines in parts.items():
            (folder / f"events_{n}_{app}_{attempt}").write_text("\n".join(lines) + "\n")
    log("whole", "9", {1: [start("whole", "9", 1000), other], 2: [other], 3: [other, end(8000)]})
    log("whole", "10", {1: [start("whole", "10", 9000), other]})
    log("holed", "1", {1: [start("holed", "1", 1000)], 3: [end(2000), "{broken"]})
    (tmp_path / "single").write_text(start("single", None, 5) + "\n" + end(6) + "\n")
    read = runs_from_event_log(spark, str(tmp_path))
    apps = {r["app_id"]: [(a["attempt"], a["completed"], a["duration"], a["gap"]) for a in r["attempts"]] for r in read.good.collect()}
    assert apps == {"whole": [("10", False, None, False), ("9", True, 7000, False)], "holed": [("1", True, 1000, True)], "single": [("1", True, 1, False)]}
    assert [r["record"] for r in read.bad.collect()] == ["{broken"]
    measured = M.latest_attempt(read.good, "name", "started", "app_id", "attempts")
    assert {r["pipeline"]: r["state"] for r in measured.collect()} == {"whole": "false", "holed": "true", "single": "true"}


def test_an_sms_to_three_numbers_is_one_send(spark):
    m = spark.createDataFrame([(p, c, 0.0, None, None, None, None, True) for p in "pq" for c in "ab"], MEASURES)
    results = evaluate(specs_frame(spark, [{"pipeline": p, "check": c} for p in "pq" for c in "ab"]), m, as_of=AS_OF)
    sms = {"type": "sms", "recipients": ["+1", "+2", "+3"]}
    assert route_alerts(results, [sms]).count() == 12
    assert run_report(results, route_alerts(results, [sms])).first()["alerts_sent"] == 4
    assert run_report(results, route_alerts(results, [sms, {"type": "slack"}, {"type": "email", "recipients": ["a", "b"]}])).first()["alerts_sent"] == 12
    assert run_report(results).first()["alerts_sent"] == 0
