"""Source and sink queries: S1-S7, S10."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.common import EVENTS_AS_OF, ORDERS_AS_OF, out, table
from suite.q_lag import offsets, offsets_sql
from suite.q_probes import STATIC_SQL, static_results
from suite.q_runs import runs
from suite.q_series import EXPORT_LINES_SQL, export_lines
from suite.registry import query
from suite.sqlkit import ge, select_out, values
from vigil import operators as M
from vigil.plans.alerts import route_alerts
from vigil.plans.evaluate import evaluate
from vigil.plans.specs import specs_frame
from vigil.session import scratch_path
from vigil.sources import file_listing, parse_documents, parsed_lines, register_views, snapshot_diff, table_source, write_outbox

# ---------------------------------------------------------------- S1 relational query (SQL on views)
S01_SPECS = [("F", 5000.0), ("O", 5000.0), ("P", 5000.0), ("X", 5000.0)]


@query("s01_relational_query", sql=f"""
WITH m AS (SELECT o_orderstatus AS pipeline, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1),
j AS (SELECT s.pipeline, m.v, s.threshold AS t FROM {values(S01_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "sql_scalar", ge("v", "t", "sql_scalar")[0], "v", "t", ge("v", "t", "sql_scalar")[1])} FROM j
""")
def s01_relational_query(spark, sf):
    register_views(spark, sf, ["orders"])
    frame = spark.sql("SELECT o_orderstatus AS pipeline, count(*) AS n FROM orders GROUP BY o_orderstatus")
    measures = M.keyed_scalar(frame, "pipeline", "n")
    specs = specs_frame(spark, [{"pipeline": p, "check": "sql_scalar", "threshold": t, "params": {"profile": "postgres"}}
                                for p, t in S01_SPECS])
    return out(evaluate(specs, measures, as_of=ORDERS_AS_OF))


# ---------------------------------------------------------------- S2 warehouse table by path
S02_SPECS = [("F", 15000.0), ("O", 15000.0), ("Z", 15000.0)]


@query("s02_table_source", sql=f"""
WITH m AS (SELECT l_linestatus AS pipeline, CAST(count(*) AS DOUBLE) AS v FROM lineitem WHERE l_quantity > 25 GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(m.v, 0.0) AS v, s.threshold AS t FROM {values(S02_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "row_count", ge("v", "t", "row_count")[0], "v", "t", ge("v", "t", "row_count")[1])} FROM j
""")
def s02_table_source(spark, sf):
    li = table_source(spark, f"{sf.rstrip('/')}/lineitem.parquet", fmt="parquet")
    measures = M.row_count(li, "l_linestatus", where=F.col("l_quantity") > 25)
    specs = specs_frame(spark, [{"pipeline": p, "check": "row_count", "threshold": t, "params": {"profile": "bigquery"}}
                                for p, t in S02_SPECS])
    return out(evaluate(specs, measures, as_of=ORDERS_AS_OF))


# ---------------------------------------------------------------- S3 file listing of the data folder
S03_GLOBS = {"parquet-files": "*.parquet", "order-files": "order*", "csv-files": "*.csv"}


@query("s03_file_listing", sql=f"""
WITH f AS (SELECT regexp_extract(file, '[^/]*$') AS name FROM glob('/root/testdata/sf0.01/*')),
m AS (SELECT 'parquet-files' AS pipeline, CAST(count(*) FILTER (WHERE name LIKE '%.parquet') AS DOUBLE) AS v FROM f
      UNION ALL SELECT 'order-files', CAST(count(*) FILTER (WHERE name LIKE 'order%') AS DOUBLE) FROM f
      UNION ALL SELECT 'csv-files', CAST(count(*) FILTER (WHERE name LIKE '%.csv') AS DOUBLE) FROM f),
j AS (SELECT pipeline, v, 14.0 AS t FROM m)
SELECT {select_out("pipeline", "file_count", ge("v", "t", "file_count")[0], "v", "t", ge("v", "t", "file_count")[1])} FROM j
""")
def s03_file_listing(spark, sf):
    listing = file_listing(spark, sf)
    measures = M.file_count(listing, S03_GLOBS, path="path", bare_names=True)
    specs = specs_frame(spark, [{"pipeline": p, "check": "file_count", "threshold": 14.0, "params": {"profile": "sftp"}}
                                for p in S03_GLOBS])
    return out(evaluate(specs, measures, as_of=ORDERS_AS_OF))


# ---------------------------------------------------------------- S3: two snapshots of an inventory kept as a table
@query("s03_snapshot_diff", sql="""
WITH l AS (SELECT concat_ws('/', user_id, event_type, hour(ts)) AS path, ts FROM events),
b AS (SELECT path, count(*) AS size, max(ts) AS at FROM l WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1),
a AS (SELECT path, count(*) AS size, max(ts) AS at FROM l WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1)
SELECT path, CASE WHEN b.at IS NULL THEN 'new' WHEN a.at IS NULL THEN 'vanished'
                  WHEN a.at = b.at AND a.size = b.size THEN 'same' ELSE 'changed' END AS change,
       CAST(coalesce(a.size, 0) - coalesce(b.size, 0) AS BIGINT) AS grown
FROM b FULL JOIN a USING (path)
""")
def s03_snapshot_diff(spark, sf):
    """Objects written by the events: the first snapshot holds those before the 20th, the second those kept since the 10th."""
    events = table(spark, sf, "events").select("ts", F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.hour("ts").cast("string")).alias("path"))

    def listing(which):
        return events.where(which).groupBy("path").agg(F.max("ts").alias("modificationTime"), F.count("*").alias("length"))
    diff = snapshot_diff(listing("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), listing("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    return diff.select("path", "change", (F.coalesce("length", F.lit(0)) - F.coalesce("length_before", F.lit(0))).alias("grown"))


# ---------------------------------------------------------------- S4 JSON documents in a column
S04_SPECS = [("signup", 20.0), ("view", 20.0), ("click", 20.0), ("error", 20.0), ("purchase", 20.0), ("refund", 20.0)]


@query("s04_json_documents", sql=f"""
WITH m AS (SELECT event_type AS pipeline, CAST(count(*) AS DOUBLE) AS v FROM events
           WHERE TRY_CAST(json_extract(props, '$.k') AS INTEGER) >= 90 GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(m.v, 0.0) AS v, s.threshold AS t FROM {values(S04_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "doc_count", ge("v", "t", "doc_count")[0], "v", "t", ge("v", "t", "doc_count")[1])} FROM j
""")
def s04_json_documents(spark, sf):
    ev = parse_documents(table(spark, sf, "events"), "props", "k INT")
    measures = M.row_count(ev, "event_type", where=F.col("_doc.k") >= 90, check="doc_count")
    specs = specs_frame(spark, [{"pipeline": p, "check": "doc_count", "threshold": t, "params": {"profile": "mongodb"}}
                                for p, t in S04_SPECS])
    return out(evaluate(specs, measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- S5 offsets of a log
@query("s05_offsets", sql=f"""
SELECT topic, CAST(partition AS BIGINT) AS partition, CAST(end_offset AS BIGINT) AS end_offset,
       CAST(committed AS DOUBLE) AS committed FROM {offsets_sql(1)}
""")
def s05_offsets(spark, sf):
    o = offsets(spark, sf, 1)
    return o.select("topic", "partition", "end_offset", F.col("committed").cast("double").alias("committed"))


# ---------------------------------------------------------------- S6 run history
@query("s06_run_history", sql="""
SELECT CASE WHEN o_orderstatus = 'F' THEN 'Success' WHEN o_orderstatus = 'O' THEN 'Running'
            WHEN o_orderpriority = '5-LOW' THEN 'Cancelled' ELSE 'Error' END AS state,
       count(*) AS runs, count(DISTINCT o_custkey) AS jobs, max(o_orderkey) AS newest_run_id,
       CAST(sum(trunc(o_totalprice * 10.0)) AS BIGINT) AS total_duration_ms
FROM orders GROUP BY 1
""")
def s06_run_history(spark, sf):
    r = runs(spark, sf, "dbt")
    return r.groupBy("state").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("job").alias("jobs"),
                                  F.max("run_id").alias("newest_run_id"),
                                  F.sum("duration_ms").cast("long").alias("total_duration_ms"))


# ---------------------------------------------------------------- S7 line-delimited JSON export, bad lines dropped
S07_SPECS = [("signup", 1500.0), ("view", 1500.0), ("click", 1500.0), ("error", 1500.0), ("purchase", 1500.0)]


@query("s07_ndjson_export", sql=f"""
WITH m AS (SELECT event_type AS pipeline, CAST(count(*) AS DOUBLE) AS v FROM {EXPORT_LINES_SQL} l WHERE json_valid(line) GROUP BY 1),
j AS (SELECT s.pipeline, m.v, s.threshold AS t FROM {values(S07_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "row_count", ge("v", "t", "row_count")[0], "v", "t", ge("v", "t", "row_count")[1])} FROM j
""")
def s07_ndjson_export(spark, sf):
    ev = table(spark, sf, "events")
    lines = parsed_lines(ev.select("event_type", export_lines(ev).alias("line")), "line")
    specs = specs_frame(spark, [{"pipeline": p, "check": "row_count", "threshold": t, "params": {"profile": "splunk"}}
                                for p, t in S07_SPECS])
    return out(evaluate(specs, M.row_count(lines, "event_type"), as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- S10 outbox sink, read back
SINK_CHANNELS = [{"type": "log"}, {"type": "slack"}, {"type": "sms", "recipients": ["+15559990000", "+15558880000"]}]


@query("s10_outbox_sink", sql=f"""
WITH a AS (SELECT * FROM ({STATIC_SQL}) WHERE alert_on_failure AND status <> 'ok')
SELECT 'log' AS channel, count(*) AS n FROM a UNION ALL SELECT 'slack', count(*) FROM a UNION ALL SELECT 'sms', 2 * count(*) FROM a
""")
def s10_outbox_sink(spark, sf):
    path = scratch_path(spark, "outbox")
    write_outbox(route_alerts(static_results(spark, sf), SINK_CHANNELS), path)
    back = spark.read.json(path)
    return back.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- S8 commented CSV export, read back
S08_SPECS = [("signup", 25.0), ("view", 25.0), ("click", 25.0), ("error", 25.0), ("purchase", 25.0), ("refund", 25.0)]


@query("s08_commented_csv", sql=f"""
WITH r AS (SELECT event_type AS pipeline, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events),
j AS (SELECT s.pipeline, r.value AS v, s.threshold AS t FROM {values(S08_SPECS, ["pipeline", "threshold"])}
      LEFT JOIN r ON r.pipeline = s.pipeline AND r.rn = 1)
SELECT {select_out("pipeline", "last_row_value", ge("v", "t", "last_row_value")[0], "v", "t", ge("v", "t", "last_row_value")[1])} FROM j
""")
def s08_commented_csv(spark, sf):
    """events exported as an annotated CSV (a ``#datatype`` line per table among
    the data lines), read back with ``#`` lines dropped; the last row of each
    table (by row number) gives the value."""
    from vigil.sources import commented_csv
    ev = table(spark, sf, "events")
    data = ev.select(F.lit("_result").alias("result"), F.col("event_type").alias("table"),
                     F.col("event_id").cast("string").alias("row"), F.col("value").cast("string").alias("_value"))
    notes = ev.select("event_type").distinct().select(
        F.lit("#datatype").alias("result"), F.lit("string").alias("table"), F.lit("long").alias("row"),
        F.lit("double").alias("_value"))
    path = scratch_path(spark, "s08-csv")
    # The writer quotes values starting with its own comment character; give it
    # another one so the annotation lines stay real ``#`` comment lines.
    data.unionByName(notes).write.option("header", "true").option("comment", "~").csv(path)
    back = commented_csv(spark, path)
    measures = M.last_row_value(back, "table", "_value", order=[F.col("row").try_cast("long")])
    specs = specs_frame(spark, [{"pipeline": p, "check": "last_row_value", "threshold": t, "params": {"profile": "influxdb"}}
                                for p, t in S08_SPECS])
    return out(evaluate(specs, measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- S4 / S7: an export with broken lines
def _broken_export(spark, sf):
    """The events as JSON lines in the shared folder; every click with k = 3 is cut off."""
    from vigil.session import scratch_path
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    whole = F.to_json(F.struct(F.col("event_type").alias("kind"), k.alias("k")))
    lines = ev.select(F.when((F.col("event_type") == "click") & (k == 3), F.left(whole, F.lit(12))).otherwise(whole).alias("value"))
    path = scratch_path(spark, "broken-export")
    lines.write.text(path)
    return path


_BROKEN_SQL = "event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS INTEGER) = 3"


@query("s04_bad_records", sql=f"""
WITH b AS (SELECT count(*) AS n FROM events WHERE {_BROKEN_SQL})
SELECT t AS pipeline, 'row_count' AS "check", 'unknown' AS status, CAST(NULL AS DOUBLE) AS value, 1.0 AS threshold,
       'row_count: ' || n || ' bad records' AS message
FROM (VALUES ('signup'), ('view'), ('click'), ('error'), ('purchase'), ('refund')) q(t), b
""")
def s04_bad_records(spark, sf):
    """A source with lines that can't be read is unknown for all its pipelines, with the count."""
    from vigil.sources import json_documents
    from vigil.sources.records import unless_bad
    read = json_documents(spark, _broken_export(spark, sf), "kind string, k int")
    specs = specs_frame(spark, [{"pipeline": t, "check": "row_count"} for t in ("signup", "view", "click", "error", "purchase", "refund")])
    return out(evaluate(specs, unless_bad(M.row_count(read.good, "kind"), read.bad, specs)))


@query("s07_export_report", sql=f"""
SELECT count(*) FILTER (WHERE NOT ({_BROKEN_SQL})) AS n_good, count(*) FILTER (WHERE {_BROKEN_SQL}) AS n_bad FROM events
""")
def s07_export_report(spark, sf):
    """The file reader of an export: records read and lines reported as bad."""
    from vigil.sources import ndjson_export
    read = ndjson_export(spark, _broken_export(spark, sf))
    both = read.good.select(F.lit(1).alias("good")).unionByName(read.bad.select(F.lit(0).alias("good")))
    return both.agg(F.count_if(F.col("good") == 1).alias("n_good"), F.count_if(F.col("good") == 0).alias("n_bad"))
