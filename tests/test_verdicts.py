"""Edge rules of the verdicts on literal rows (boundaries, NULL, NaN, profiles)."""

from helpers import AS_OF, rows
from vigil.plans.evaluate import evaluate
from vigil.plans.specs import specs_frame
from vigil.schema import MEASURES


def measures(spark, data):
    """data: list of (pipeline, check, value, raw, state, aux)."""
    full = [(p, c, v, r, s, None, a, True) for p, c, v, r, s, a in data]
    return spark.createDataFrame(full, MEASURES)


def test_ge_boundary_default_and_missing(spark):
    m = measures(spark, [("eq", "kv", None, "3", None, None), ("below", "kv", None, "3", None, None),
                         ("dflt", "kv", 1.0, None, None, None), ("zero", "kv", 0.0, None, None, None)])
    specs = specs_frame(spark, [{"pipeline": "eq", "check": "kv", "threshold": 3}, {"pipeline": "below", "check": "kv", "threshold": 5},
                                {"pipeline": "dflt", "check": "kv"}, {"pipeline": "zero", "check": "kv"},
                                {"pipeline": "missing", "check": "kv", "threshold": 1}])
    r = rows(evaluate(specs, m, as_of=AS_OF), "status", "value", "threshold")
    assert r["eq"] == ("ok", 3.0, 3.0)
    assert r["below"] == ("critical", 3.0, 5.0)
    assert r["dflt"] == ("ok", 1.0, 1.0)
    assert r["zero"][0] == "critical"
    assert r["missing"][0] == "unknown"


def test_redis_int_parse(spark):
    m = measures(spark, [("five", "kv", None, "5", None, None), ("nan", "kv", None, "not-a-number", None, None),
                         ("frac", "kv", None, "2.7", None, None), ("pad", "kv", None, " 7 ", None, None)])
    specs = specs_frame(spark, [{"pipeline": p, "check": "kv", "threshold": 1, "params": {"profile": "redis"}}
                                for p in ("five", "nan", "frac", "pad", "absent")])
    r = rows(evaluate(specs, m, as_of=AS_OF), "status", "message")
    assert r["five"][0] == "ok"
    assert r["nan"] == ("unknown", "kv: non-numeric value 'not-a-number'")
    assert r["frac"][0] == "unknown"
    assert r["pad"][0] == "ok"
    assert r["absent"] == ("unknown", "kv: no data")


def test_nan_and_infinities(spark):
    m = measures(spark, [(p, "x", v, None, None, None) for p, v in
                         [("nan_ge", float("nan")), ("nan_gt", float("nan")), ("nan_le", float("nan")),
                          ("inf_ge", float("inf")), ("ninf_le", float("-inf")), ("nan_int", float("nan"))]])
    specs = specs_frame(spark, [
        {"pipeline": "nan_ge", "check": "x", "op": "ge", "threshold": 1},
        {"pipeline": "nan_gt", "check": "x", "op": "gt", "threshold": 0},
        {"pipeline": "nan_le", "check": "x", "op": "le", "threshold": 5},
        {"pipeline": "inf_ge", "check": "x", "op": "ge", "threshold": 1},
        {"pipeline": "ninf_le", "check": "x", "op": "le", "threshold": 0},
        {"pipeline": "nan_int", "check": "x", "op": "ge", "threshold": 1, "params": {"profile": "trino"}},
    ])
    r = rows(evaluate(specs, m, as_of=AS_OF), "status")
    assert r == {"nan_ge": ("critical",), "nan_gt": ("critical",), "nan_le": ("critical",), "inf_ge": ("ok",),
                 "ninf_le": ("ok",), "nan_int": ("unknown",)}


def test_int_and_float_profiles_differ(spark):
    m = measures(spark, [("as_int", "x", -0.5, None, None, None), ("as_float", "x", -0.5, None, None, None)])
    specs = specs_frame(spark, [{"pipeline": "as_int", "check": "x", "threshold": 0, "params": {"profile": "trino"}},
                                {"pipeline": "as_float", "check": "x", "threshold": 0, "params": {"profile": "postgres"}}])
    r = rows(evaluate(specs, m, as_of=AS_OF), "status")
    assert r == {"as_int": ("ok",), "as_float": ("critical",)}


def test_empty_result_profiles(spark):
    m = measures(spark, [("nullv", "q", None, None, None, None)])
    specs = specs_frame(spark, [
        {"pipeline": "e_pg", "check": "q", "params": {"profile": "postgres"}},
        {"pipeline": "e_duck", "check": "q", "threshold": 0, "params": {"profile": "duckdb"}},
        {"pipeline": "nullv", "check": "q", "params": {"profile": "postgres"}},
    ])
    hive = specs_frame(spark, [{"pipeline": "nullv", "check": "q", "threshold": 0, "params": {"profile": "hive"}}])
    r = rows(evaluate(specs, m, as_of=AS_OF), "status", "message")
    assert r["e_pg"] == ("unknown", "q: no data")
    assert r["e_duck"][0] == "ok"
    assert r["nullv"] == ("unknown", "q: null value")
    assert rows(evaluate(hive, m, as_of=AS_OF), "status")["nullv"] == ("ok",)


def test_threshold_chain_and_mongo_zero(spark):
    m = measures(spark, [("a", "lag", 70000.0, None, None, None), ("b", "lag", 30000.0, None, None, None),
                         ("c", "docs", 1.0, None, None, None)])
    specs = specs_frame(spark, [{"pipeline": "a", "check": "lag", "op": "le"}, {"pipeline": "b", "check": "lag", "op": "le"},
                                {"pipeline": "c", "check": "docs", "threshold": 0,
                                 "params": {"zero_is_unset": "true"}}])
    r = rows(evaluate(specs, m, as_of=AS_OF, defaults={"lag": 60000}), "status", "threshold")
    assert r["a"] == ("critical", 60000.0)
    assert r["b"] == ("ok", 60000.0)
    assert r["c"] == ("ok", 1.0)


def test_le_any_between_max_age_count_recent(spark):
    m = measures(spark, [("sub", "backlog", 9999.0, None, None, None), ("pend", "backlog", 20.0, None, None, None),
                         ("t_ok", "tasks", 3.0, None, None, None), ("t_low", "tasks", 0.0, None, None, None),
                         ("t_high", "tasks", 8.0, None, None, None), ("t_none", "tasks", 0.0, None, None, None),
                         ("fresh", "age", 2.0, None, None, None), ("stale", "age", 30.0, None, None, None),
                         ("obj_old", "objs", 1.0, None, None, 48.0), ("obj_new", "objs", 1.0, None, None, 0.5),
                         ("obj_few", "objs", 3.0, None, None, 0.5)])
    specs = specs_frame(spark, [
        {"pipeline": "sub", "check": "backlog", "op": "le_any", "threshold": -1},
        {"pipeline": "pend", "check": "backlog", "op": "le", "threshold": 20},
        {"pipeline": "t_ok", "check": "tasks", "op": "between", "threshold": 1, "max_threshold": 10},
        {"pipeline": "t_low", "check": "tasks", "op": "between", "threshold": 2},
        {"pipeline": "t_high", "check": "tasks", "op": "between", "threshold": 0, "max_threshold": 5},
        {"pipeline": "t_none", "check": "tasks", "op": "between"},
        {"pipeline": "fresh", "check": "age", "op": "max_age", "max_age_hours": 12},
        {"pipeline": "stale", "check": "age", "op": "max_age"},
        {"pipeline": "obj_old", "check": "objs", "op": "count_recent", "max_age_hours": 1},
        {"pipeline": "obj_new", "check": "objs", "op": "count_recent", "max_age_hours": 1},
        {"pipeline": "obj_few", "check": "objs", "op": "count_recent", "threshold": 5},
    ])
    r = rows(evaluate(specs, m, as_of=AS_OF), "status")
    assert r == {"sub": ("ok",), "pend": ("ok",), "t_ok": ("ok",), "t_low": ("critical",), "t_high": ("critical",),
                 "t_none": ("ok",), "fresh": ("ok",), "stale": ("critical",), "obj_old": ("critical",),
                 "obj_new": ("ok",), "obj_few": ("critical",)}


def test_state_maps(spark):
    airflow = [("a_success", "success"), ("a_failed", "failed"), ("a_running", "running"), ("a_upper", "SUCCESS")]
    dbt = [("d_success", "Success"), ("d_error", "Error"), ("d_cancel", "Cancelled"), ("d_running", "Running"),
           ("d_queued", "Queued"), ("d_lower", "success")]
    data = [(p, "run", None, None, s, None) for p, s in airflow + dbt]
    data += [("db_ok", "run", None, "TERMINATED", "SUCCESS", None), ("db_fail", "run", None, "TERMINATED", "FAILED", None),
             ("db_to", "run", None, "TERMINATED", "TIMEDOUT", None), ("db_run", "run", None, "RUNNING", None, None),
             ("db_odd", "run", None, "TERMINATED", "SKIPPED", None)]
    data += [("sp_ok", "att", 12000.0, None, "true", None), ("sp_zero", "att", 0.0, None, "true", None),
             ("sp_run", "att", 5.0, None, "false", None)]
    m = measures(spark, data)
    spec_rows = [{"pipeline": p, "check": "run", "op": "state_airflow"} for p, _ in airflow]
    spec_rows += [{"pipeline": p, "check": "run", "op": "state_dbt"} for p, _ in dbt]
    spec_rows += [{"pipeline": p, "check": "run", "op": "state_databricks"} for p in ("db_ok", "db_fail", "db_to", "db_run", "db_odd", "db_none")]
    spec_rows += [{"pipeline": p, "check": "att", "op": "completed"} for p in ("sp_ok", "sp_zero", "sp_run")]
    r = rows(evaluate(specs_frame(spark, spec_rows), m, as_of=AS_OF), "status")
    expect = {"a_success": "ok", "a_failed": "critical", "a_running": "unknown", "a_upper": "ok",
              "d_success": "ok", "d_error": "critical", "d_cancel": "critical", "d_running": "unknown",
              "d_queued": "unknown", "d_lower": "unknown",
              "db_ok": "ok", "db_fail": "critical", "db_to": "critical", "db_run": "unknown", "db_odd": "unknown",
              "db_none": "unknown", "sp_ok": "ok", "sp_zero": "critical", "sp_run": "unknown"}
    assert {k: v[0] for k, v in r.items()} == expect


def test_duration_sla_warning(spark):
    m = measures(spark, [("slow", "run", 7200000.0, None, "success", None), ("fast", "run", 60000.0, None, "success", None),
                         ("failed_slow", "run", 7200000.0, None, "failed", None)])
    specs = specs_frame(spark, [{"pipeline": p, "check": "run", "op": "state_airflow", "max_duration_seconds": 3600}
                                for p in ("slow", "fast", "failed_slow")])
    r = rows(evaluate(specs, m, as_of=AS_OF), "status", "message")
    assert r["slow"] == ("warning", "run state=success; run took 7200 s, over 3600 s")
    assert r["fast"][0] == "ok"
    assert r["failed_slow"][0] == "critical"


def test_static_status(spark):
    from vigil.operators import static_status
    ov = spark.createDataFrame([("warn_pipe", "warning", "slow", None), ("fail_pipe", "critical", "boom", None),
                                ("odd", "not_a_real_status", "x", None), ("legacy", "FAILED", "", None)],
                               "pipeline string, status string, message string, last_run timestamp_ntz")
    specs = specs_frame(spark, [{"pipeline": p, "check": "static_status"} for p in
                                ("warn_pipe", "fail_pipe", "odd", "legacy", "any_pipeline")])
    r = rows(evaluate(specs, static_status(ov), as_of=AS_OF), "status", "message")
    assert r["warn_pipe"] == ("warning", "slow")
    assert r["fail_pipe"] == ("critical", "boom")
    assert r["odd"][0] == "unknown"
    assert r["legacy"][0] == "critical"
    assert r["any_pipeline"] == ("ok", "Static check for any_pipeline")


def test_every_spec_one_result_even_with_duplicate_measures_absent(spark):
    m = measures(spark, [("a", "c1", 5.0, None, None, None), ("a", "c2", 0.0, None, None, None)])
    specs = specs_frame(spark, [{"pipeline": "a", "check": "c1"}, {"pipeline": "a", "check": "c2"},
                                {"pipeline": "b", "check": "c1"}])
    res = evaluate(specs, m, as_of=AS_OF)
    assert res.count() == 3
    st = {(r["pipeline"], r["check"]): r["status"] for r in res.collect()}
    assert st == {("a", "c1"): "ok", ("a", "c2"): "critical", ("b", "c1"): "unknown"}


def test_message_templates(spark):
    m = measures(spark, [("t1", "lag", 2.0, None, None, None), ("t2", "lag", 100.0, None, None, None)])
    tmpl = {"message_ok": "Consumer lag {value} is within threshold ({threshold})",
            "message_fail": "Consumer lag {value} exceeds threshold ({threshold}) on {pipeline}"}
    specs = specs_frame(spark, [{"pipeline": p, "check": "lag", "op": "le", "threshold": 5, "params": tmpl}
                                for p in ("t1", "t2", "t3")])
    r = rows(evaluate(specs, m, as_of=AS_OF), "status", "message")
    assert r["t1"] == ("ok", "Consumer lag 2 is within threshold (5)")
    assert r["t2"] == ("critical", "Consumer lag 100 exceeds threshold (5) on t2")
    assert r["t3"] == ("unknown", "lag: no data")


def test_eq_without_expected_is_unknown(spark):
    m = measures(spark, [("svc", "code", 1.0, None, None, None), ("svc2", "code", 2.0, None, None, None)])
    specs = specs_frame(spark, [{"pipeline": "svc", "check": "code", "op": "eq"},
                                {"pipeline": "svc2", "check": "code", "op": "eq", "expected": "1"}])
    r = rows(evaluate(specs, m, as_of=AS_OF), "status", "message")
    assert r["svc"] == ("unknown", "code: missing setting 'expected'")
    assert r["svc2"] == ("critical", "code 2, expected 1")
    with_default = rows(evaluate(specs, m, as_of=AS_OF, defaults={"code": 1}), "status")
    assert with_default["svc"] == ("ok",)
