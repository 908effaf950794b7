"""Measures on literal tables restating the reference's mocked sources."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from vigil import operators as M
from vigil.plans.evaluate import as_of_lit, evaluate
from vigil.plans.specs import specs_frame

AS_OF = dt.datetime(2024, 6, 1, 12, 0, 0)


def run(spark, measures, specs, **kw):
    return rows(evaluate(specs_frame(spark, specs), measures, as_of=AS_OF, **kw), "status", "value")


def test_consumer_lag(spark):
    off = spark.createDataFrame([("orders", 0, 100, 98), ("events", 0, 200, 100), ("events", 1, 5, None)],
                                "topic string, partition long, end_offset long, committed long")
    specs = [{"pipeline": "orders", "check": "total_lag", "threshold": 5},
             {"pipeline": "events", "check": "total_lag", "threshold": 50},
             {"pipeline": "nothing", "check": "total_lag", "threshold": 5}]
    r = run(spark, M.total_lag(off), specs)
    assert r["orders"] == ("ok", 2.0)
    assert r["events"] == ("critical", 105.0)       # missing committed counts from 0
    assert r["nothing"][0] == "unknown"


def test_event_hub_lag_sum_and_missing_read(spark):
    off = spark.createDataFrame([("hub", 0, 10, 8), ("hub", 1, 10, 9), ("bad", 0, 10, 6), ("bad", 1, 10, 6),
                                 ("fresh", 0, 50, None)], "topic string, partition long, end_offset long, last_read long")
    specs = [{"pipeline": p, "check": "total_lag_received", "threshold": 5} for p in ("hub", "bad", "fresh")]
    r = run(spark, M.total_lag_received(off), specs)
    assert r == {"hub": ("ok", 3.0), "bad": ("critical", 8.0), "fresh": ("ok", 0.0)}


def test_shard_lag(spark):
    sh = spark.createDataFrame([("s1", "a", 1000), ("s2", "a", 120000), ("s3", "a", 1000), ("s3", "b", 90000),
                                ("s4", "a", None)], "stream string, shard string, lag_ms long")
    specs = [{"pipeline": p, "check": "max_lag_ms"} for p in ("s1", "s2", "s3", "s4", "s5")]
    r = run(spark, M.max_lag_ms(sh), specs, defaults={"max_lag_ms": 60000})
    assert r["s1"] == ("ok", 1000.0)
    assert r["s2"][0] == "critical"
    assert r["s3"] == ("critical", 90000.0)
    assert r["s4"] == ("ok", 0.0)
    assert r["s5"][0] == "unknown"


def test_backlog_and_zero_backlog(spark):
    produced = spark.createDataFrame([(1, "q1"), (2, "q1"), (3, "q1"), (4, "q2")], "id long, queue string")
    acked = spark.createDataFrame([(1,), (1,), (4,)], "id long")
    r = run(spark, M.backlog(produced, acked, "id", "queue"),
            [{"pipeline": "q1", "check": "backlog", "threshold": 1}, {"pipeline": "q2", "check": "backlog"}])
    assert r == {"q1": ("critical", 2.0), "q2": ("ok", 0.0)}


def test_active_tasks(spark):
    task = "struct<delivery_info: struct<routing_key: string, exchange: string>>"
    df = spark.createDataFrame(
        [({"worker1@host": [{"delivery_info": {"routing_key": "etl", "exchange": "etl"}},
                            {"delivery_info": {"routing_key": "etl", "exchange": None}},
                            {"delivery_info": {"routing_key": "other", "exchange": "etl"}}]},),
         ({"worker2@host": [{"delivery_info": {"routing_key": "other", "exchange": None}}]},)],
        f"tasks map<string, array<{task}>>")
    specs = [{"pipeline": "etl", "check": "active_tasks", "threshold": 1, "max_threshold": 10,
              "params": {"profile": "celery"}},
             {"pipeline": "other", "check": "active_tasks", "threshold": 0, "max_threshold": 1, "params": {"profile": "celery"}},
             {"pipeline": "idle", "check": "active_tasks", "params": {"profile": "celery"}},
             {"pipeline": "needed", "check": "active_tasks", "threshold": 2, "params": {"profile": "celery"}}]
    r = run(spark, M.active_tasks(df, "tasks"), specs)
    assert r["etl"] == ("ok", 3.0)
    assert r["other"] == ("critical", 2.0)
    assert r["idle"] == ("ok", 0.0)
    assert r["needed"] == ("critical", 0.0)


def test_objects_prefix_globs_and_recency(spark):
    objs = spark.createDataFrame(
        [("data/a.csv", dt.datetime(2024, 6, 1, 11, 30), 10), ("data/b.json", dt.datetime(2024, 5, 30, 12, 0), 20),
         ("logs/x.csv", dt.datetime(2024, 5, 1), 5), ("/exports/report.csv", dt.datetime(2024, 5, 1), 1),
         ("/exports/report.json", dt.datetime(2024, 5, 1), 1), ("/exports/Report.CSV", dt.datetime(2024, 5, 1), 1)],
        "path string, modificationTime timestamp_ntz, length long")
    r = run(spark, M.object_count(objs, {"data": "data/", "none": "nothing/"}),
            [{"pipeline": "data", "check": "object_count"}, {"pipeline": "none", "check": "object_count"}])
    assert r == {"data": ("ok", 2.0), "none": ("critical", 0.0)}
    g = M.file_count(objs, {"csv_full": "*.csv", "exports": "/exports/*", "not_data": "[!d]*", "everything": ""})
    names = M.file_count(objs, {"csv_name": "*.csv", "q": "?.csv"}, bare_names=True)
    r = run(spark, g.unionByName(names), [{"pipeline": p, "check": "file_count"} for p in
                                           ("csv_full", "exports", "not_data", "everything", "csv_name", "q")])
    assert {k: v[1] for k, v in r.items()} == {"csv_full": 3.0, "exports": 3.0, "not_data": 4.0, "everything": 6.0,
                                               "csv_name": 3.0, "q": 2.0}
    keyed = objs.withColumn("bucket", F.split("path", "/")[0])
    rec = M.recent_objects(keyed, "bucket", as_of_lit(AS_OF))
    r = run(spark, rec, [{"pipeline": "data", "check": "recent_objects", "max_age_hours": 1},
                         {"pipeline": "logs", "check": "recent_objects", "max_age_hours": 1},
                         {"pipeline": "", "check": "recent_objects", "threshold": 5}])
    assert r["data"][0] == "ok"
    assert r["logs"][0] == "critical"
    assert r[""][0] == "critical"


def test_freshness_from_iso_text(spark):
    src = spark.createDataFrame([("ds1", "2024-06-01T10:00:00Z"), ("ds2", "2024-05-01T10:00:00Z"), ("ds3", ""),
                                 ("ds4", "2024-05-31T13:00:00")], "pipeline string, updated_at string")
    m = M.age_hours(src, "pipeline", "updated_at", as_of_lit(AS_OF))
    r = run(spark, m, [{"pipeline": "ds1", "check": "age_hours", "max_age_hours": 12},
                       {"pipeline": "ds2", "check": "age_hours"}, {"pipeline": "ds3", "check": "age_hours"},
                       {"pipeline": "ds4", "check": "age_hours"}, {"pipeline": "ds5", "check": "age_hours"}])
    assert r["ds1"] == ("ok", 2.0)
    assert r["ds2"][0] == "critical"
    assert r["ds3"][0] == "unknown"
    assert r["ds4"] == ("ok", 23.0)
    assert r["ds5"][0] == "unknown"


def test_latest_point_null_stays_unknown_and_ties(spark):
    pts = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 42.0, 1), ("a", dt.datetime(2023, 1, 1), 1.0, 2),
                                 ("b", dt.datetime(2024, 1, 1), 5.0, 1), ("b", dt.datetime(2024, 1, 2), None, 2),
                                 ("c", dt.datetime(2024, 1, 1), 1.0, 1), ("c", dt.datetime(2024, 1, 1), 99.0, 2)],
                                "series string, ts timestamp_ntz, value double, id long")
    m = M.latest_point(pts, "series", "ts", "value", tiebreak="id")
    r = run(spark, m, [{"pipeline": p, "check": "latest_point", "threshold": 10} for p in "abcd"])
    assert r["a"] == ("ok", 42.0)
    assert r["b"][0] == "unknown"
    assert r["c"] == ("ok", 99.0)
    assert r["d"][0] == "unknown"


def test_windowed_stat(spark):
    base = dt.datetime(2024, 6, 1, 12, 0, 0)
    pts = spark.createDataFrame([("ok", base - dt.timedelta(minutes=1), 2.0), ("ok", base - dt.timedelta(minutes=2), 3.0),
                                 ("ok", base - dt.timedelta(minutes=7), 100.0), ("old", base - dt.timedelta(minutes=8), 4.0),
                                 ("zero", base - dt.timedelta(minutes=1), 0.0), ("gone", base - dt.timedelta(hours=2), 9.0)],
                                "series string, ts timestamp_ntz, value double")
    m = M.windowed_stat(pts, "series", as_of_lit(AS_OF), period_seconds=300, stat="Sum", ts="ts", value="value")
    r = run(spark, m, [{"pipeline": p, "check": "windowed_stat", "threshold": 1} for p in ("ok", "old", "zero", "gone")])
    assert r["ok"] == ("ok", 5.0)
    assert r["old"] == ("ok", 4.0)
    assert r["zero"] == ("critical", 0.0)
    assert r["gone"][0] == "unknown"


def test_json_number_and_truthiness(spark):
    docs = spark.createDataFrame([(p, dt.datetime(2024, 1, 1), d) for p, d in [
        ("n_ok", '{"stats": {"row_count": 42}}'), ("n_zero", '{"stats": {"row_count": 0}}'),
        ("n_missing", '{"other": {}}'), ("n_text", '{"stats": {"row_count": "12"}}'),
        ("n_bool", '{"stats": {"row_count": true}}'), ("n_list", '{"stats": {"row_count": [1]}}')]],
        "pipeline string, ts timestamp_ntz, doc string")
    r = run(spark, M.json_number_measure(docs, "pipeline", "doc", "stats.row_count"),
            [{"pipeline": p, "check": "json_number", "threshold": 1} for p in
             ("n_ok", "n_zero", "n_missing", "n_text", "n_bool", "n_list")])
    assert r["n_ok"] == ("ok", 42.0)
    assert r["n_zero"][0] == "critical"
    assert r["n_missing"][0] == "unknown"
    assert r["n_text"] == ("ok", 12.0)
    assert r["n_bool"] == ("ok", 1.0)
    assert r["n_list"][0] == "unknown"
    bodies = [("t_true", '{"data": {"ok": true}}'), ("t_zero", '{"status": 0}'), ("t_null", '{"status": null}'),
              ("t_false_text", '{"status": "false"}'), ("t_empty_list", '{"status": []}'), ("t_obj", '{"status": {}}'),
              ("t_missing", '{"other": 1}'), ("t_zero_float", '{"status": 0.0}'), ("t_list_null", '{"status": [null]}')]
    probes = spark.createDataFrame([(p, dt.datetime(2024, 1, 1), 200, b) for p, b in bodies],
                                   "pipeline string, ts timestamp_ntz, code int, body string")
    paths = {"t_true": "data.ok"}
    frames = [M.json_truthy_measure(probes.where(F.col("pipeline") == p), "pipeline", "body", paths.get(p, "status"))
              for p, _ in bodies]
    m = frames[0]
    for f in frames[1:]:
        m = m.unionByName(f)
    r = run(spark, m, [{"pipeline": p, "check": "json_truthy"} for p, _ in bodies])
    assert {k: v[0] for k, v in r.items()} == {
        "t_true": "ok", "t_zero": "critical", "t_null": "critical", "t_false_text": "ok", "t_empty_list": "critical",
        "t_obj": "critical", "t_missing": "unknown", "t_zero_float": "critical", "t_list_null": "ok"}


def test_http_probe_order(spark):
    pr = spark.createDataFrame([("up", dt.datetime(2024, 1, 1), 200, '{"data": {"ok": true}}'),
                                ("down", dt.datetime(2024, 1, 1), 500, '{"data": {"ok": true}}'),
                                ("falsy", dt.datetime(2024, 1, 1), 200, '{"data": {"ok": 0}}'),
                                ("nokey", dt.datetime(2024, 1, 1), 200, '{"data": {}}')],
                               "pipeline string, ts timestamp_ntz, code int, body string")
    m = M.probe_status(pr, "pipeline", "code", "body", path="data.ok")
    specs = [{"pipeline": p, "check": "probe_status", "params": {"json_path": "data.ok"}} for p in ("up", "down", "falsy", "nokey")]
    r = rows(evaluate(specs_frame(spark, specs), m, as_of=AS_OF), "status", "message")
    assert r["up"] == ("ok", "probe_status 200 OK")
    assert r["down"] == ("critical", "probe_status expected 200, got 500")
    assert r["falsy"][0] == "critical"
    assert r["nokey"][0] == "unknown"


def test_first_line_with_field_stops_at_first(spark):
    lines = spark.createDataFrame([("s", 1, "garbage {"), ("s", 2, '{"other": 1}'), ("s", 3, '{"count": "abc"}'),
                                   ("s", 4, '{"count": "10"}'), ("t", 1, '{"count": "10"}'), ("u", 1, '{"count": "2"}')],
                                  "pipeline string, n int, line string")
    m = M.first_line_with_field(lines, "pipeline", "line", "count", order=[F.col("n")])
    r = run(spark, m, [{"pipeline": p, "check": "first_line_field", "threshold": 5} for p in ("s", "t", "u", "v")])
    assert r["s"][0] == "unknown"
    assert r["t"] == ("ok", 10.0)
    assert r["u"] == ("critical", 2.0)
    assert r["v"][0] == "unknown"


def test_commented_csv_last_row(spark, tmp_path):
    from vigil.sources import commented_csv, with_row_order
    p = tmp_path / "flux.csv"
    p.write_text("#group,false,false,true\n#datatype,string,long,double\n\n,result,table,_value\n,_result,0,3\n,_result,0,5\n")
    df = with_row_order(commented_csv(spark, str(p))).withColumn("k", F.lit("influx"))
    m = M.last_row_value(df, "k", "_value", order=[F.col("_file"), F.col("_block"), F.col("_pos")])
    r = run(spark, m, [{"pipeline": "influx", "check": "last_row_value", "threshold": 4}])
    assert r["influx"] == ("ok", 5.0)
    empty = tmp_path / "empty.csv"
    empty.write_text("#group,false\n,result,table,_value\n")
    assert commented_csv(spark, str(empty)).count() == 0


def test_latest_attempt_top_n(spark):
    apps = spark.createDataFrame(
        [(f"app{i}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i,
          [{"completed": i % 3 != 0, "duration": 0 if i % 4 == 0 else 1000 * i}]) for i in range(30)],
        "name string, started timestamp_ntz, id long, attempts array<struct<completed: boolean, duration: long>>")
    m = M.latest_attempt(apps, "name", "started", "id", "attempts", top_n=20)
    r = run(spark, m, [{"pipeline": f"app{i}", "check": "latest_attempt"} for i in (29, 28, 27, 5)])
    assert r["app29"][0] == "ok"
    assert r["app28"][0] == "critical"     # completed, duration 0
    assert r["app27"][0] == "unknown"      # not completed
    assert r["app5"][0] == "unknown"       # not among the newest 20


def test_kv_missing_setting_is_unknown_and_name_carried(spark):
    kv = spark.createDataFrame([("jobs:done", "5"), ("jobs:zero", "0")], "key string, value string")
    specs = specs_frame(spark, [{"pipeline": "done", "check": "kv_value", "params": {"key": "jobs:done"}},
                                {"pipeline": "zero", "check": "kv_value", "params": {"key": "jobs:zero"}},
                                {"pipeline": "no_key", "check": "kv_value"}])
    res = evaluate(specs, M.kv_value(kv, specs), as_of=AS_OF)
    r = rows(res, "status", "message")
    assert r["done"] == ("ok", "kv_value 5 meets threshold 1")
    assert r["zero"] == ("critical", "kv_value 0 below threshold 1")
    assert r["no_key"] == ("unknown", "kv_value: no data")
    assert sorted(x["pipeline"] for x in res.collect()) == ["done", "no_key", "zero"]


def test_queue_depth_exact_and_approximate(spark):
    log = spark.range(0, 3000).select((F.col("id") % 3).cast("string").alias("q"), (F.col("id") % 1000).alias("msg"))
    exact = {r["pipeline"]: r["value"] for r in M.queue_depth(log, "q", distinct="msg").collect()}
    approx = {r["pipeline"]: r["value"] for r in M.queue_depth(log, "q", distinct="msg", approx=True).collect()}
    want = {str(q): float(len({i % 1000 for i in range(3000) if i % 3 == q})) for q in range(3)}
    assert exact == want
    assert all(abs(approx[k] - exact[k]) / exact[k] < 0.05 for k in exact)


def test_hot_key_holding_a_third_of_rows(spark):
    """One key with a third of the rows: results equal a per-key reference and the
    plan aggregates partially before the shuffle."""
    n = 30000
    df = spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("value"),
        F.col("id").alias("id"))
    m = M.latest_point(df.repartition(16), "k", "ts", "value", tiebreak="id")
    got = {r["pipeline"]: r["value"] for r in m.collect()}
    assert got["hot"] == float(n - 3)   # the largest id divisible by 3
    assert len(got) == 1 + 97
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_many_prefixes_take_the_grouped_plan(spark):
    objs = spark.createDataFrame([(f"p{i % 100}/file{i}",) for i in range(1000)], "path string")
    prefixes = {f"n{i}": f"p{i}/" for i in range(150)}
    got = {r["pipeline"]: r["value"] for r in M.object_count(objs, prefixes).collect()}
    assert len(got) == 150
    assert got["n0"] == 10.0 and got["n99"] == 10.0 and got["n120"] == 0.0
    few = {r["pipeline"]: r["value"] for r in M.object_count(objs, {"a": "p1/", "b": "zz"}).collect()}
    assert few == {"a": 10.0, "b": 0.0}


def test_backlog_until_salted_equals_plain(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")))
    acks = hot.where(F.col("event_type") == "purchase")
    plain = {r["pipeline"]: r["value"] for r in M.backlog_until(hot, acks, "user_id", "ts", "event_type").collect()}
    salted = {r["pipeline"]: r["value"] for r in
              M.backlog_until(hot, acks, "user_id", "ts", "event_type", salt=8).collect()}
    assert plain == salted and len(plain) == 5


def test_source_error_is_unknown_for_that_check_only(spark):
    from vigil.plans.evaluate import check_all
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    ok = M.guarded(spark, lambda: M.row_count(orders, "o_orderpriority"), "row_count")
    broken = M.guarded(spark, lambda: M.row_count(spark.read.parquet("/nonexistent/table"), "x", check="lost"), "lost")
    specs = specs_frame(spark, [{"pipeline": "1-URGENT", "check": "row_count"}, {"pipeline": "a", "check": "lost"}])
    r = rows(check_all(specs, [ok, broken], as_of=AS_OF), "status", "message")
    assert r["1-URGENT"][0] == "ok"
    assert r["a"] == ("unknown", "lost: no data")


def test_failed_source_is_unknown_under_every_profile(spark):
    from vigil.plans.evaluate import check_all
    specs = specs_frame(spark, [{"pipeline": p, "check": "lost", "op": o, "threshold": 0.0, "max_threshold": 5.0, "params": {"profile": p}}
                                for p, o in (("azure_eventhub", "le"), ("celery", "between"), ("mysql", "ge"), ("postgres", "ge"))])
    lost = M.guarded(spark, lambda: M.row_count(spark.read.parquet("/nonexistent/table"), "x", check="lost"), "lost", specs)
    got = rows(check_all(specs, [lost], as_of=AS_OF), "status", "message")
    assert set(got.values()) == {("unknown", "lost: source error")} and len(got) == 4


def test_evaluation_time_ignores_driver_and_session_zone(spark):
    import os
    import time
    from vigil.plans.evaluate import as_of_lit
    import datetime as dt
    zone, old = spark.conf.get("spark.sql.session.timeZone"), os.environ.get("TZ")
    try:
        os.environ["TZ"] = "America/New_York"
        time.tzset()
        for session in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session)
            got = spark.range(1).select(as_of_lit(dt.datetime(2024, 1, 31, 12)).cast("string").alias("x")).first()["x"]
            assert got == "2024-01-31 12:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        os.environ.pop("TZ", None)
        if old is not None:
            os.environ["TZ"] = old
        time.tzset()


def test_instants_with_offsets(spark):
    from vigil.operators.freshness import parse_instant
    texts = ["2024-01-01T12:00:00+02:00", "2024-01-01T12:00:00-0530", "2024-01-01T12:00:00Z", "2024-01-01 12:00:00", "", "x", None, "2024-01-01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parse_instant(F.col("t")).cast("string")).collect()] == [
        "2024-01-01 10:00:00", "2024-01-01 17:30:00", "2024-01-01 12:00:00", "2024-01-01 12:00:00", None, None, None, "2024-01-01 00:00:00"]


def test_zones_are_honoured_or_the_text_is_no_time(spark):
    from vigil.operators.freshness import parse_instant
    texts = {"2024-01-01T12:00:00+02": "2024-01-01 10:00:00", "2024-01-01T12:00:00 +02:00": "2024-01-01 10:00:00", "2024-01-01 12:00:00 -0130": "2024-01-01 13:30:00",
             "2024-01-01T12:00:00 Z": "2024-01-01 12:00:00", "2024-01-01T12:00:00.5+01": "2024-01-01 11:00:00.5", "2024-01-01T12:00:00 CET": None,
             "2024-01-01T12:00:00[Europe/Berlin]": None, "2024-01-01T12:00:00 Europe/Berlin": None, "2024-01-01T12:00:00+2": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", parse_instant(F.col("t")).cast("string")).collect()} == texts


def test_period_edges_belong_to_the_newer_period(spark):
    as_of = F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")
    pts = spark.createDataFrame([("a", "2024-01-01 00:05:00", "9"), ("b", "2024-01-01 00:00:00", "9"), ("c", "2024-01-01 00:06:00", "n/a"),
                                 ("c", "2024-01-01 00:01:00", "5")], "k string, ts string, value string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = rows(M.windowed_stat(pts, "k", as_of, 300, "Sum", 2), "value")
    assert got == {"a": (9.0,), "b": (9.0,), "c": (0.0,)}


def test_values_keep_their_types(spark):
    docs = spark.createDataFrame([("p", '{"x": true}'), ("p", '{"x": 5}'), ("p", '{"x": "5"}'), ("p", '{"x": 5.0}'), ("p", '{"x": "true"}')], "k string, d string")
    n = lambda v: rows(M.doc_count(docs, "k", "d", {"x": v}), "value").get("p", (0,))[0]
    assert [n(True), n(5), n("5"), n("true"), n(False)] == [1, 2, 1, 1, 0]
    one = M.sql_scalar(spark, "SELECT count(*) > 0 FROM range(3)", "p").first()
    assert one["value"] == 1.0
    text = spark.createDataFrame([("für dich",), ("f r",)], "text string")
    assert rows(M.text_match_count(text, {"a": "text:für", "b": "text:r"}), "value") == {"a": (1.0,), "b": (1.0,)}
    kv = spark.createDataFrame([("k", "1", 1), ("k", "9", 2), ("k", "5", 3)], "key string, value string, at int")
    specs = specs_frame(spark, [{"pipeline": "p", "check": "kv_value", "params": {"key": "k", "on": True}}])
    assert [r["raw"] for r in M.kv_value(kv, specs, order="at").collect()] == ["5"]
    assert specs.first()["params"]["on"] == "true"


def test_glob_end_is_the_end(spark):
    from vigil.functions.globs import glob_match
    df = spark.createDataFrame([("a.html",), ("a.html\n",)], "x string")
    assert [r[0] for r in df.select(glob_match(F.col("x"), "*.html")).collect()] == [True, False]
