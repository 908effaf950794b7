"""Object / file listing and freshness queries: M23-M26 (V6, V7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.common import ORDERS_AS_OF, ORDERS_AS_OF_SQL, orders_as_of, out, table
from suite.registry import query
from suite.sqlkit import ge, num, select_out
from vigil import operators as M
from vigil.plans.evaluate import evaluate
from vigil.plans.specs import normalize_specs, specs_frame

# ---------------------------------------------------------------- M23 object_count (prefix)
M23_PREFIXES = {"https": "https://", "http-blog": "http://blog.", "https-m": "https://m.", "ftp": "ftp://"}


def _m23_sql():
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS pipeline, CAST(count(*) FILTER (WHERE starts_with(url, '{p}')) AS DOUBLE) AS v FROM pages"
        for name, p in M23_PREFIXES.items())
    st, msg = ge("v", "t", "object_count")
    return f"WITH j AS (SELECT pipeline, v, 40.0 AS t FROM ({parts})) SELECT {select_out('pipeline', 'object_count', st, 'v', 't', msg)} FROM j"


@query("m23_object_count", sql=_m23_sql())
def m23_object_count(spark, sf):
    pages = table(spark, sf, "pages")
    measures = M.object_count(pages, M23_PREFIXES, path="url")
    specs = specs_frame(spark, [{"pipeline": p, "check": "object_count", "threshold": 40.0} for p in M23_PREFIXES])
    return out(evaluate(specs, measures, as_of=ORDERS_AS_OF))


# ---------------------------------------------------------------- M24 file_count (fnmatch globs)
M24_FULL = {"html": "*.html", "en-path": "*/en/*", "with-query": "*[?]*", "fr-or-de": "*/[fd][re]/*",
            "not-https": "[!h]*", "all": ""}
M24_NAMES = {"name-html": "*.html", "name-digits": "[0-9]*", "name-q": "??"}
# The same selections as anchored regular expressions, written out for the twin.
M24_FULL_RE = {"html": r".*\.html", "en-path": ".*/en/.*", "with-query": r".*\?.*", "fr-or-de": ".*/[fd][re]/.*",
               "not-https": "[^h].*", "all": ".*"}
M24_NAMES_RE = {"name-html": r".*\.html", "name-digits": "[0-9].*", "name-q": ".."}


def _m24_sql():
    parts = [f"SELECT '{n}' AS pipeline, CAST(count(*) FILTER (WHERE regexp_full_match(url, '{r}', 's')) AS DOUBLE) AS v FROM pages"
             for n, r in M24_FULL_RE.items()]
    parts += [f"SELECT '{n}' AS pipeline, CAST(count(*) FILTER (WHERE regexp_full_match(regexp_extract(url, '[^/]*$'), '{r}', 's')) AS DOUBLE) AS v FROM pages"
              for n, r in M24_NAMES_RE.items()]
    st, msg = ge("v", "t", "file_count")
    return (f"WITH j AS (SELECT pipeline, v, 20.0 AS t FROM ({' UNION ALL '.join(parts)})) "
            f"SELECT {select_out('pipeline', 'file_count', st, 'v', 't', msg)} FROM j")


@query("m24_file_count", sql=_m24_sql())
def m24_file_count(spark, sf):
    pages = table(spark, sf, "pages")
    measures = M.file_count(pages, M24_FULL, path="url").unionByName(
        M.file_count(pages, M24_NAMES, path="url", bare_names=True))
    specs = specs_frame(spark, [{"pipeline": p, "check": "file_count", "threshold": 20.0}
                                for p in list(M24_FULL) + list(M24_NAMES)])
    return out(evaluate(specs, measures, as_of=ORDERS_AS_OF))


# ---------------------------------------------------------------- M25 recent_objects (V7)
def _customer_specs(spark, sf, check, threshold, max_age_rule=None, op=None):
    cust = table(spark, sf, "customer")
    age = F.lit(None).cast("double") if max_age_rule is None else max_age_rule
    return normalize_specs(cust.select(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("pipeline"),
        F.lit(check).alias("check"), F.lit(op).cast("string").alias("op"),
        F.lit(threshold).cast("double").alias("threshold"), age.alias("max_age_hours")))


@query("m25_recent_objects", sql=f"""
WITH m AS (SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS pipeline, CAST(count(*) AS DOUBLE) AS n,
                  date_diff('microsecond', max(o_orderdate), {ORDERS_AS_OF_SQL}) / 3.6e9 AS age FROM orders GROUP BY 1),
s AS (SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS pipeline,
             CASE WHEN c_nationkey < 12 THEN 8760.0 END AS h FROM customer),
j AS (SELECT s.pipeline, m.n AS v, m.age, s.h, 10.0 AS t FROM s LEFT JOIN m USING (pipeline))
SELECT pipeline, 'recent_objects' AS "check",
       CASE WHEN v IS NULL THEN 'unknown' WHEN v >= t AND (h IS NULL OR age <= h) THEN 'ok' ELSE 'critical' END AS status,
       v AS value, t AS threshold,
       CASE WHEN v IS NULL THEN 'recent_objects: no data'
            WHEN v >= t AND (h IS NULL OR age <= h) THEN 'recent_objects ' || {num('v')} || ' meets threshold 10'
            WHEN NOT (v >= t) THEN 'recent_objects ' || {num('v')} || ' below threshold 10'
            ELSE 'recent_objects ' || {num('v')} || ', none modified within ' || {num('h')} || 'h' END AS message
FROM j
""")
def m25_recent_objects(spark, sf):
    orders = table(spark, sf, "orders")
    measures = M.recent_objects(orders, F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")), orders_as_of(),
                                mtime="o_orderdate")
    cust_age = F.when(F.col("c_nationkey") < 12, F.lit(8760.0))
    specs = _customer_specs(spark, sf, "recent_objects", 10.0, cust_age)
    return out(evaluate(specs, measures, as_of=ORDERS_AS_OF))


# ---------------------------------------------------------------- M26 age_hours from ISO text (V6)
@query("m26_age_hours", sql=f"""
WITH m AS (SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS pipeline,
                  date_diff('microsecond', max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END), {ORDERS_AS_OF_SQL}) / 3.6e9 AS v
           FROM orders GROUP BY 1),
s AS (SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS pipeline FROM customer),
j AS (SELECT s.pipeline, m.v, m.pipeline IS NOT NULL AS present, 8760.0 AS h FROM s LEFT JOIN m USING (pipeline))
SELECT pipeline, 'age_hours' AS "check",
       CASE WHEN v IS NULL THEN 'unknown' WHEN v <= h THEN 'ok' ELSE 'critical' END AS status, v AS value, h AS threshold,
       CASE WHEN NOT present THEN 'age_hours: no data' WHEN v IS NULL THEN 'age_hours: null value'
            WHEN v <= h THEN 'age_hours ' || {num('v')} || 'h old, within 8760h'
            ELSE 'age_hours ' || {num('v')} || 'h old, exceeds 8760h' END AS message
FROM j
""")
def m26_age_hours(spark, sf):
    orders = table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    src = orders.select(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("k"), text.alias("updated_at"))
    measures = M.age_hours(src, "k", "updated_at", orders_as_of())
    specs = _customer_specs(spark, sf, "age_hours", None, F.lit(8760.0))
    return out(evaluate(specs, measures, as_of=ORDERS_AS_OF))


