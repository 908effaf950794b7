"""Count family queries: M1-M8, M20 (with V1, V15 and the profiles of 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.common import out, table
from suite.registry import query
from suite.sqlkit import ge, int_parse, select_out, values
from vigil import operators as M
from vigil.operators.winners import newest_rows
from vigil.plans.evaluate import evaluate
from vigil.plans.specs import normalize_specs, specs_frame

# ---------------------------------------------------------------- M1 row_count
M01_SPECS = [("1-URGENT", 3000.0), ("2-HIGH", 3000.0), ("3-MEDIUM", 3000.0), ("4-NOT SPECIFIED", 3000.0),
             ("5-LOW", 3000.0), ("6-NONE", 3000.0), ("1-URGENT-OPEN", None)]


def m01_results(spark, sf):
    orders = table(spark, sf, "orders")
    measures = M.row_count(orders, "o_orderpriority").unionByName(
        M.row_count(orders, F.concat("o_orderpriority", F.lit("-OPEN")), where="o_orderstatus = 'O'"))
    specs = specs_frame(spark, [{"pipeline": p, "check": "row_count", "threshold": t, "params": {"profile": "mysql"}}
                                for p, t in M01_SPECS])
    return evaluate(specs, measures, as_of="2001-08-02T00:00:00")


@query("m01_row_count", sql=f"""
WITH m AS (
  SELECT o_orderpriority AS pipeline, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1
  UNION ALL
  SELECT o_orderpriority || '-OPEN', CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(m.n, 0.0) AS v, COALESCE(s.threshold, 1.0) AS t
      FROM {values(M01_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "row_count", ge("v", "t", "row_count")[0], "v", "t", ge("v", "t", "row_count")[1])} FROM j
""")
def m01_row_count(spark, sf):
    return out(m01_results(spark, sf))


# ---------------------------------------------------------------- M2 sql_scalar
M02_QUERIES = {
    "revenue_A": "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_returnflag = 'A'",
    "revenue_N": "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_returnflag = 'N'",
    "revenue_R": "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_returnflag = 'R'",
    "max_qty_per_order": "SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey ORDER BY q DESC, l_orderkey LIMIT 5",
    "no_rows": "SELECT l_quantity FROM lineitem WHERE l_quantity < 0",
}
M02_THRESHOLD = 300000000.0


def _m02_spark(spark, sf):
    from vigil.sources.tables import register_views
    register_views(spark, sf, ["lineitem"])
    frames = [M.sql_scalar(spark, q, p) for p, q in M02_QUERIES.items()]
    measures = frames[0]
    for f in frames[1:]:
        measures = measures.unionByName(f)
    specs = specs_frame(spark, [{"pipeline": p, "check": "sql_scalar", "threshold": M02_THRESHOLD if p.startswith("revenue") else 10,
                                 "params": {"profile": "postgres"}} for p in M02_QUERIES])
    return out(evaluate(specs, measures, as_of="2001-08-02T00:00:00"))


def _m02_sql():
    parts = []
    for p, q in M02_QUERIES.items():
        parts.append(f"SELECT '{p}' AS pipeline, (SELECT CAST(x.c AS DOUBLE) FROM (SELECT * FROM ({q}) LIMIT 1) x(c)) AS v")
    measures = " UNION ALL ".join(parts)
    t = f"(CASE WHEN pipeline LIKE 'revenue%' THEN {M02_THRESHOLD} ELSE 10.0 END)"
    st, msg = ge("v", "t", "sql_scalar")
    return f"WITH j AS (SELECT pipeline, v, {t} AS t FROM ({measures})) SELECT {select_out('pipeline', 'sql_scalar', st, 'v', 't', msg)} FROM j"


query("m02_sql_scalar", sql=_m02_sql())(_m02_spark)


# ---------------------------------------------------------------- M3 doc_count (mongo threshold: 0 = unset)
M03_SPECS = [("signup", 20.0), ("view", 0.0), ("click", 25.0), ("error", None), ("purchase", 20.0), ("refund", 0.0)]


@query("m03_doc_count", sql=f"""
WITH m AS (SELECT event_type AS pipeline, CAST(count(*) AS DOUBLE) AS n FROM events
           WHERE json_extract_string(props, '$.k') = '5' GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(m.n, 0.0) AS v, COALESCE(NULLIF(s.threshold, 0.0), 1.0) AS t
      FROM {values(M03_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "doc_count", ge("v", "t", "doc_count")[0], "v", "t", ge("v", "t", "doc_count")[1])} FROM j
""")
def m03_doc_count(spark, sf):
    events = table(spark, sf, "events")
    measures = M.doc_count(events, "event_type", "props", {"k": 5})
    specs = specs_frame(spark, [{"pipeline": p, "check": "doc_count", "threshold": t,
                                 "params": {"profile": "mongodb", "zero_is_unset": "true"}} for p, t in M03_SPECS])
    return out(evaluate(specs, measures))


# ---------------------------------------------------------------- M4 index_count (index patterns)
M04_PATTERNS = {"src1x-en": "src1*-en", "all-de": "*-de", "src0-any": "src0-*", "src-q-es": "src?-es",
                "src-class": "src[13]-[!e]*", "nothing": "zz*"}


def _m04_sql():
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS pipeline, CAST(count(*) AS DOUBLE) AS n FROM documents WHERE (source || '-' || lang) GLOB '{pat}'"
        for name, pat in M04_PATTERNS.items())
    st, msg = ge("v", "t", "index_count")
    return (f"WITH j AS (SELECT pipeline, n AS v, 100.0 AS t FROM ({parts})) "
            f"SELECT {select_out('pipeline', 'index_count', st, 'v', 't', msg)} FROM j")


@query("m04_index_count", sql=_m04_sql())
def m04_index_count(spark, sf):
    docs = table(spark, sf, "documents")
    measures = M.index_count(docs, F.concat("source", F.lit("-"), "lang"), M04_PATTERNS)
    specs = specs_frame(spark, [{"pipeline": p, "check": "index_count", "threshold": 100.0,
                                 "params": {"profile": "elasticsearch"}} for p in M04_PATTERNS])
    return out(evaluate(specs, measures))


# ---------------------------------------------------------------- M5 text_match_count
M05_QUERIES = {"q-the": "text:the", "q-und": "text:UND", "q-all": "*:*", "q-la": "text:la", "q-none": "text:zzqqzz", "q-fuer": "text:für", "q-r": "text:r"}


def _m05_sql():
    parts = []
    for name, q in M05_QUERIES.items():
        if q == "*:*":
            pred = "TRUE"
        else:
            term = q.split(":", 1)[1].lower()
            pred = f"list_contains(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), '{term}')"
        parts.append(f"SELECT '{name}' AS pipeline, CAST(count(*) FILTER (WHERE {pred}) AS DOUBLE) AS n FROM documents")
    st, msg = ge("v", "t", "text_match_count")
    return (f"WITH j AS (SELECT pipeline, n AS v, 200.0 AS t FROM ({' UNION ALL '.join(parts)})) "
            f"SELECT {select_out('pipeline', 'text_match_count', st, 'v', 't', msg)} FROM j")


@query("m05_text_match_count", sql=_m05_sql())
def m05_text_match_count(spark, sf):
    docs = table(spark, sf, "documents")
    measures = M.text_match_count(docs, M05_QUERIES)
    specs = specs_frame(spark, [{"pipeline": p, "check": "text_match_count", "threshold": 200.0,
                                 "params": {"profile": "solr"}} for p in M05_QUERIES])
    return out(evaluate(specs, measures))


# ---------------------------------------------------------------- M6 paged_count
M06_SPECS = [("A", 14000.0), ("N", 30000.0), ("R", 14000.0), ("X", None)]


@query("m06_paged_count", sql=f"""
WITH pages AS (SELECT l_returnflag AS flag, year(l_shipdate) AS y,
                      CASE WHEN year(l_shipdate) = 1995 THEN NULL ELSE count(*) END AS n
               FROM lineitem GROUP BY 1, 2),
m AS (SELECT flag AS pipeline, CAST(sum(COALESCE(n, 0)) AS DOUBLE) AS n FROM pages GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(m.n, 0.0) AS v, COALESCE(s.threshold, 1.0) AS t
      FROM {values(M06_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "paged_count", ge("v", "t", "paged_count")[0], "v", "t", ge("v", "t", "paged_count")[1])} FROM j
""")
def m06_paged_count(spark, sf):
    li = table(spark, sf, "lineitem")
    year = F.year("l_shipdate")
    pages = li.groupBy(F.col("l_returnflag").alias("flag"), year.alias("y")).agg(
        F.when(F.col("y") == 1995, F.lit(None)).otherwise(F.count(F.lit(1))).alias("n"))
    measures = M.paged_count(pages, "flag", "n")
    specs = specs_frame(spark, [{"pipeline": p, "check": "paged_count", "threshold": t,
                                 "params": {"profile": "dynamodb"}} for p, t in M06_SPECS])
    return out(evaluate(specs, measures))


# ---------------------------------------------------------------- M7 view_count
M07_SPECS = [(f"src{i}", 60000.0) for i in range(20)] + [("src99", 60000.0)]


@query("m07_view_count", sql=f"""
WITH m AS (SELECT source AS pipeline,
                  CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''))) AS DOUBLE) AS n
           FROM documents GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(m.n, 0.0) AS v, s.threshold AS t
      FROM {values(M07_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "view_count", ge("v", "t", "view_count")[0], "v", "t", ge("v", "t", "view_count")[1])} FROM j
""")
def m07_view_count(spark, sf):
    docs = table(spark, sf, "documents")
    words = F.filter(F.split("text", "[ \t\n\r]+"), lambda x: x != F.lit(""))
    measures = M.view_count(docs, "source", emitted=words)
    specs = specs_frame(spark, [{"pipeline": p, "check": "view_count", "threshold": t,
                                 "params": {"profile": "couchdb"}} for p, t in M07_SPECS])
    return out(evaluate(specs, measures))


# ---------------------------------------------------------------- M8 kv_value (int parse)
@query("m08_kv_value", sql=f"""
WITH latest AS (SELECT user_id, event_type, props,
                       row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
kv AS (SELECT 'user:' || CAST(user_id AS VARCHAR) AS k,
              CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') || '.5'
                   ELSE json_extract_string(props, '$.k') END AS v
       FROM latest WHERE rn = 1),
specs AS (SELECT DISTINCT 'user-' || CAST(user_id AS VARCHAR) AS pipeline, 'user:' || CAST(user_id AS VARCHAR) AS k FROM events
          UNION ALL SELECT 'user-none', 'user:none'),
j AS (SELECT s.pipeline, kv.v AS raw, {int_parse('kv.v')} AS v, 50.0 AS t
      FROM specs s LEFT JOIN kv USING (k))
SELECT pipeline, 'kv_value' AS "check",
       CASE WHEN v IS NULL THEN 'unknown' WHEN v >= t THEN 'ok' ELSE 'critical' END AS status,
       v AS value, t AS threshold,
       CASE WHEN raw IS NULL THEN 'kv_value: no data'
            WHEN v IS NULL THEN 'kv_value: non-numeric value ''' || raw || ''''
            WHEN v >= t THEN 'kv_value ' || CAST(CAST(v AS BIGINT) AS VARCHAR) || ' meets threshold 50'
            ELSE 'kv_value ' || CAST(CAST(v AS BIGINT) AS VARCHAR) || ' below threshold 50' END AS message
FROM j
""")
def m08_kv_value(spark, sf):
    ev = table(spark, sf, "events")
    newest = newest_rows(ev, "user_id", [F.col("ts"), F.col("event_id")], ["event_type", "props"]).select(
        "user_id", F.struct("event_type", "props").alias("e"))
    kv = newest.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("e.event_type") == "error", F.concat(F.get_json_object("e.props", "$.k"), F.lit(".5")))
        .otherwise(F.get_json_object("e.props", "$.k")).alias("value"))
    users = ev.select("user_id").distinct().select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("pipeline"),
        F.lit("kv_value").alias("check"), F.lit(50.0).alias("threshold"),
        F.create_map(F.lit("key"), F.concat(F.lit("user:"), F.col("user_id").cast("string")),
                     F.lit("profile"), F.lit("redis")).alias("params"))
    extra = specs_frame(spark, [{"pipeline": "user-none", "check": "kv_value", "threshold": 50.0,
                                 "params": {"key": "user:none", "profile": "redis"}}])
    specs = normalize_specs(users).unionByName(extra)
    return out(evaluate(specs, M.kv_value(kv, specs)))


# ---------------------------------------------------------------- M20 queue_depth
M20_SPECS = [("signup", 2000.0), ("view", 2000.0), ("click", 2000.0), ("error", 2000.0), ("purchase", 2000.0),
             ("refund", 2000.0)]


@query("m20_queue_depth", sql=f"""
WITH m AS (SELECT event_type AS pipeline, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1),
j AS (SELECT s.pipeline, COALESCE(m.n, 0.0) AS v, s.threshold AS t
      FROM {values(M20_SPECS, ["pipeline", "threshold"])} LEFT JOIN m USING (pipeline))
SELECT {select_out("pipeline", "queue_depth", ge("v", "t", "queue_depth")[0], "v", "t", ge("v", "t", "queue_depth")[1])} FROM j
""")
def m20_queue_depth(spark, sf):
    ev = table(spark, sf, "events")
    specs = specs_frame(spark, [{"pipeline": p, "check": "queue_depth", "threshold": t, "params": {"profile": "rabbitmq"}}
                                for p, t in M20_SPECS])
    return out(evaluate(specs, M.queue_depth(ev, "event_type")))


