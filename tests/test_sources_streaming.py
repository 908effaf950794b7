"""Sources (table files, Spark event logs), SQL functions and streaming late data."""

import datetime as dt
import json
import os
import tempfile

from vigil.functions.sql import register_sql_functions
from vigil.sources import runs_from_event_log, table_files

SF = "/root/testdata/sf0.001"


def test_table_files(spark):
    files = table_files(spark.read.parquet(f"{SF}/orders.parquet")).collect()
    assert len(files) == 1 and files[0]["path"].endswith("orders.parquet") and files[0]["length"] > 0


def test_runs_from_event_log(spark, tmp_path):
    def log(name, lines):
        (tmp_path / name).write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    log("app-1", [{"Event": "SparkListenerApplicationStart", "App Name": "etl", "App ID": "app-1", "Timestamp": 1000},
                  {"Event": "SparkListenerJobStart", "Job ID": 0},
                  {"Event": "SparkListenerApplicationEnd", "Timestamp": 13000}])
    log("app-2_1", [{"Event": "SparkListenerApplicationStart", "App Name": "load", "App ID": "app-2",
                     "App Attempt ID": "1", "Timestamp": 5000}])
    log("app-2_2", [{"Event": "SparkListenerApplicationStart", "App Name": "load", "App ID": "app-2",
                     "App Attempt ID": "2", "Timestamp": 9000},
                    {"Event": "SparkListenerApplicationEnd", "Timestamp": 9000}])
    apps = {r["app_id"]: r for r in runs_from_event_log(spark, str(tmp_path)).good.collect()}
    assert apps["app-1"]["name"] == "etl"
    assert apps["app-1"]["attempts"][0]["completed"] and apps["app-1"]["attempts"][0]["duration"] == 12000
    assert [a["attempt"] for a in apps["app-2"]["attempts"]] == ["2", "1"]      # newest attempt first
    assert apps["app-2"]["attempts"][0]["duration"] == 0
    assert not apps["app-2"]["attempts"][1]["completed"]


def test_sql_functions(spark):
    names = register_sql_functions(spark)
    assert "vg_ge" in names
    r = spark.sql("SELECT vg_ge(5, 1) a, vg_ge(CAST('NaN' AS DOUBLE), 1) b, vg_le(NULL, 1) c, vg_between(8, 0, 5) d, "
                  "vg_state_airflow('SUCCESS') e, vg_state_dbt('success') f, vg_state_databricks('RUNNING', 'SUCCESS') g, "
                  "vg_max_age(30, NULL) h, vg_is_healthy('warning') i").collect()[0]
    assert tuple(r) == ("ok", "critical", "unknown", "critical", "ok", "unknown", "unknown", "critical", False)


def test_stream_window_counts_drop_late_events(spark):
    from vigil.streaming import file_stream, window_counts
    from vigil.session import scratch_path
    src = tempfile.mkdtemp(prefix="vigil-src-", dir=os.environ.get("TMPDIR", "/tmp"))
    schema = "ts timestamp_ntz, topic string"
    day = dt.datetime(2024, 1, 1)

    def drop(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{name}")

    drop([(day + dt.timedelta(hours=h), "t") for h in (1, 2, 3)] + [(day + dt.timedelta(days=1, hours=5), "t")], "a")
    out = scratch_path(spark, "late-out")
    ckpt = scratch_path(spark, "late-ckpt")

    def run():
        counts = window_counts(file_stream(spark, f"{src}/*", schema), "topic", "ts", window="1 day",
                               watermark="10 minutes")
        q = (counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    # A late event for the first day (already closed by the watermark) and new ones two days later.
    drop([(day + dt.timedelta(hours=4), "t"), (day + dt.timedelta(days=3, hours=1), "t")], "b")
    run()
    got = {r["window_start"].date().isoformat(): r["n"] for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": 3, "2024-01-02": 1}


def test_late_events_counts_what_the_watermark_dropped(spark, tmp_path):
    from vigil.streaming import file_stream, late_event_measures, late_events, run_available, watermark_of, window_counts
    schema, (inp, out, state) = "k string, ts timestamp_ntz", (str(tmp_path / x) for x in ("in", "out", "state"))
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    on_time = [("a", at(1, 3)), ("a", at(1, 4)), (None, at(2, 1)), ("a", at(4, 12)), ("b", None)]
    late = [("a", at(1, 9)), ("a", at(1, 10)), ("c", at(2, 2)), (None, at(2, 3)), ("a", at(4, 1)), ("a", at(6, 1))]
    for rows in (on_time, late):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inp)
        counts = window_counts(file_stream(spark, inp, schema), "k", "ts")
        q = run_available(counts.writeStream.format("parquet").option("path", out).outputMode("append"), spark, "late", state)
    assert watermark_of(q) == dt.datetime(2024, 1, 6, 0, 50)
    got = late_events(spark.read.parquet(inp), spark.read.parquet(out), watermark_of(q), "k", "ts")
    assert {(r["pipeline"], r["window_start"].day): (r["n"], r["n_late"]) for r in got.collect()} == {
        ("a", 1): (2, 2), ("c", 2): (0, 1), (None, 2): (1, 1), ("a", 4): (2, 0)}
    assert {r["pipeline"]: r["value"] for r in late_event_measures(got).collect()} == {"a": 2.0, "c": 1.0, None: 1.0}


def test_snapshot_diff(spark):
    from vigil.sources import snapshot_diff
    t = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "path string, modificationTime timestamp_ntz, length long"
    before = spark.createDataFrame([("a", t(1), 5), ("b", t(1), 5), ("c", t(1), 5), ("c", t(2), 6), ("d", None, None), (None, t(1), 1)], schema)
    after = spark.createDataFrame([("b", t(1), 5), ("c", t(2), 7), ("d", None, None), ("e", t(3), 0), ("e", t(3), 0)], schema)
    got = {r["path"]: (r["change"], r["length_before"], r["length"]) for r in snapshot_diff(before, after).collect()}
    assert got == {"a": ("vanished", 5, None), "b": ("same", 5, 5), "c": ("changed", 6, 7), "d": ("same", None, None), "e": ("new", None, 0)}
    assert snapshot_diff(before.limit(0), after.limit(0)).collect() == []
