"""Thousands of specs on one scan: patterns (M5, M23, M24) and settings of their own."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from suite.common import EVENTS_AS_OF, EVENTS_AS_OF_SQL, events_as_of, out, table
from suite.q_series import TYPES
from suite.registry import query
from suite.sqlkit import ge, num, select_out
from vigil import operators as M
from vigil.operators.settings import filtered_counts_by_spec, json_by_spec, trailing_by_spec, windowed_by_spec
from vigil.plans.evaluate import evaluate
from vigil.plans.specs import specs_frame

SYLLABLES = ["th", "er", "on", "an", "en", "ti", "in", "re", "ed", "the", "and", "la", "de", "le", "ha", "sh", "of"]
_SYLLABLES_SQL = "s(x) AS (VALUES " + ", ".join(f"('{s}')" for s in SYLLABLES) + ")"
_NAMES_SQL = ", ".join(f"('{t}')" for t in TYPES)


def _specs(spark, check, threshold, names, params=None):
    return specs_frame(spark, [{"pipeline": p, "check": check, "threshold": threshold, "params": params(p) if params else {}} for p in names])


def _ge_sql(check, threshold, ctes, source):
    st, msg = ge("v", "t", check)
    return f"WITH {ctes}, j AS (SELECT pipeline, v, {threshold} AS t FROM ({source})) SELECT {select_out('pipeline', check, st, 'v', 't', msg)} FROM j"


# ---------------------------------------------------------------- M5, about 4 900 terms
TERMS = sorted({a + b + c for a, b, c in product(SYLLABLES, repeat=3)})


@query("m05_many_terms", sql=_ge_sql("text_match_count", "5.0", f"""{_SYLLABLES_SQL},
terms AS (SELECT DISTINCT a.x || b.x || c.x AS pipeline FROM s a, s b, s c),
w AS (SELECT DISTINCT r, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM (SELECT row_number() OVER () AS r, text FROM documents)),
n AS (SELECT word, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY word)""",
    "SELECT pipeline, COALESCE(n, 0.0) AS v FROM terms LEFT JOIN n ON word = pipeline"))
def m05_many_terms(spark, sf):
    measures = M.text_match_count(table(spark, sf, "documents"), {t: f"text:{t}" for t in TERMS})
    return out(evaluate(_specs(spark, "text_match_count", 5.0, TERMS), measures))


# ---------------------------------------------------------------- M23, 2 312 prefixes
PREFIXES = sorted({f"{a}://{b}{c}{d}" for a, b, c, d in product(["http", "https"], ["", "www.", "m.", "blog."], SYLLABLES, SYLLABLES)})


@query("m23_many_prefixes", sql=_ge_sql("object_count", "2.0", f"""{_SYLLABLES_SQL},
p AS (SELECT DISTINCT h.x || '://' || q.x || a.x || b.x AS pipeline FROM (VALUES ('http'), ('https')) h(x), (VALUES (''), ('www.'), ('m.'), ('blog.')) q(x), s a, s b),
n AS (SELECT pipeline, CAST(count(*) AS DOUBLE) AS n FROM p JOIN pages ON starts_with(url, pipeline) GROUP BY pipeline)""",
    "SELECT pipeline, COALESCE(n, 0.0) AS v FROM p LEFT JOIN n USING (pipeline)"))
def m23_many_prefixes(spark, sf):
    measures = M.object_count(table(spark, sf, "pages"), {p: p for p in PREFIXES}, path="url")
    return out(evaluate(_specs(spark, "object_count", 2.0, PREFIXES), measures))


# ---------------------------------------------------------------- M24, 3 290 globs
GLOBS = sorted({*(f"*/{i}{tail}" for i, tail in product(range(1000), [".html", "[?#]*", "/"])), "*",
                *(f"*{a}{b}?example.*/[ef]?/*" for a, b in product(SYLLABLES, repeat=2))})


@query("m24_many_globs", sql=_ge_sql("file_count", "1.0", f"""{_SYLLABLES_SQL},
g AS (SELECT '*/' || i || t.x AS pipeline FROM range(1000) r(i), (VALUES ('.html'), ('[?#]*'), ('/')) t(x)
      UNION SELECT '*' UNION SELECT '*' || a.x || b.x || '?example.*/[ef]?/*' FROM s a, s b),
n AS (SELECT pipeline, CAST(count(*) AS DOUBLE) AS n FROM g JOIN pages ON url GLOB pipeline GROUP BY pipeline)""",
    "SELECT pipeline, COALESCE(n, 0.0) AS v FROM g LEFT JOIN n USING (pipeline)"))
def m24_many_globs(spark, sf):
    measures = M.file_count(table(spark, sf, "pages"), {g: g for g in GLOBS}, path="url")
    return out(evaluate(_specs(spark, "file_count", 1.0, GLOBS), measures))


# ---------------------------------------------------------------- M29, 1 000 specs of 50 paths
def _wide_doc():
    """{"m": {"k0": .., "k49": ..}}: numbers from the event's own; every seventh a text, some missing."""
    k = F.get_json_object("props", "$.k").cast("int")
    fields = [(F.lit("n/a") if j % 7 == 3 else F.lit(None).cast("string") if j % 11 == 5 else (k * (j + 1)) % 100).alias(f"k{j}") for j in range(50)]
    return F.to_json(F.struct(F.struct(*fields).alias("m")))


@query("m29_paths_by_spec", sql=f"""
WITH newest AS (SELECT 'svc-' || user_id AS endpoint, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                       row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
s AS (SELECT 'chk-' || i AS pipeline, 'svc-' || (i % 160) AS endpoint, i % 50 AS j FROM range(1000) r(i)),
j AS (SELECT pipeline, j, k IS NOT NULL AS present, CASE WHEN j % 7 <> 3 AND j % 11 <> 5 THEN CAST((k * (j + 1)) % 100 AS DOUBLE) END AS v
      FROM s LEFT JOIN newest n ON n.endpoint = s.endpoint AND rn = 1)
SELECT pipeline, 'json_number' AS "check",
       CASE WHEN v IS NULL THEN 'unknown' WHEN v >= 50 THEN 'ok' ELSE 'critical' END AS status, v AS value, 50.0 AS threshold,
       CASE WHEN NOT present THEN 'json_number: no data' WHEN j % 7 = 3 THEN 'json_number: non-numeric value ''"n/a"'''
            WHEN v IS NULL THEN 'json_number: null value'
            WHEN v >= 50 THEN 'json_number ' || {num('v')} || ' meets threshold 50'
            ELSE 'json_number ' || {num('v')} || ' below threshold 50' END AS message
FROM j
""")
def m29_paths_by_spec(spark, sf):
    probes = table(spark, sf, "events").select(
        F.concat(F.lit("svc-"), F.col("user_id").cast("string")).alias("service"), "ts", "event_id", _wide_doc().alias("doc"))
    specs = specs_frame(spark, [{"pipeline": f"chk-{i}", "check": "json_number", "threshold": 50.0,
                                 "params": {"endpoint": f"svc-{i % 160}", "json_path": f"m.k{i % 50}"}} for i in range(1000)])
    return out(evaluate(specs, json_by_spec(probes, specs, "service", "doc", tiebreak="event_id"), as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M9 / M10, 600 trailing ranges
@query("m10_minutes_by_spec", sql=_ge_sql("latest_point", "25.0", f"""t(x) AS (VALUES {_NAMES_SQL}),
s AS (SELECT x || '-' || m AS pipeline, x, m * 30 AS minutes FROM t, range(1, 101) r(m)),
r AS (SELECT event_type, value, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= {EVENTS_AS_OF_SQL})""",
    f"""SELECT pipeline, value AS v FROM s LEFT JOIN r ON event_type = x AND rn = 1
        AND date_diff('microsecond', ts, {EVENTS_AS_OF_SQL}) <= CAST(minutes AS BIGINT) * 60000000"""))
def m10_minutes_by_spec(spark, sf):
    specs = specs_frame(spark, [{"pipeline": f"{t}-{m}", "check": "latest_point", "threshold": 25.0,
                                 "params": {"series": t, "minutes": str(m * 30)}} for t in TYPES for m in range(1, 101)])
    measures = trailing_by_spec(table(spark, sf, "events"), specs, "event_type", events_as_of(), tiebreak="event_id")
    return out(evaluate(specs, measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M11, period and statistic per spec
PERIODS = [6 * 3600, 86_400, 2 * 86_400, 5 * 86_400]
STATISTICS = ["Sum", "Average", "Minimum", "Maximum", "SampleCount"]


@query("m11_periods_by_spec", sql=_ge_sql("windowed_stat", "30.0", f"""t(x) AS (VALUES {_NAMES_SQL}),
l(p) AS (VALUES {", ".join(f"({p})" for p in PERIODS)}), q(stat) AS (VALUES {", ".join(f"('{s}')" for s in STATISTICS)}),
a AS (SELECT event_type AS x, value, date_diff('microsecond', ts, {EVENTS_AS_OF_SQL}) AS age FROM events),
b AS (SELECT x, p, CAST(ceil(age / (p * 1000000.0)) AS INTEGER) - 1 AS b, value FROM a, l WHERE age > 0 AND age <= CAST(p AS BIGINT) * 2000000),
g AS (SELECT x, p, b, CAST(sum(CAST(value AS DECIMAL(38,4))) AS DOUBLE) AS total, count(value) AS n, count(*) AS every, min(value) AS low, max(value) AS high FROM b GROUP BY ALL),
h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY x, p ORDER BY b) = 1)""",
    """SELECT t.x || '-' || l.p || '-' || stat AS pipeline,
       CASE WHEN h.x IS NOT NULL THEN COALESCE(CASE stat WHEN 'Sum' THEN total WHEN 'Average' THEN total / n WHEN 'Minimum' THEN low
            WHEN 'Maximum' THEN high ELSE CAST(every AS DOUBLE) END, 0.0) END AS v
       FROM t CROSS JOIN l CROSS JOIN q LEFT JOIN h ON h.x = t.x AND h.p = l.p"""))
def m11_periods_by_spec(spark, sf):
    specs = specs_frame(spark, [{"pipeline": f"{t}-{p}-{s}", "check": "windowed_stat", "threshold": 30.0,
                                 "params": {"series": t, "period_seconds": str(p), "stat": s}} for t in TYPES for p in PERIODS for s in STATISTICS])
    measures = windowed_by_spec(table(spark, sf, "events"), specs, "event_type", events_as_of())
    return out(evaluate(specs, measures, as_of=EVENTS_AS_OF))


# ---------------------------------------------------------------- M3, a filter per spec
@query("m03_filters_by_spec", sql=_ge_sql("doc_count", "30.0", f"""t(x) AS (VALUES {_NAMES_SQL}),
s AS (SELECT x || '-' || k AS pipeline, x, k FROM t, range(100) r(k) UNION ALL SELECT x || '-all', x, -1 FROM t UNION ALL SELECT x || '-text', x, -2 FROM t),
m AS (SELECT event_type AS x, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2
      UNION ALL SELECT event_type, -1, CAST(count(*) AS DOUBLE) FROM events GROUP BY 1)""",
    "SELECT pipeline, COALESCE(n, 0.0) AS v FROM s LEFT JOIN m USING (x, k)"))
def m03_filters_by_spec(spark, sf):
    wanted = [(f"{t}-{k}", {"collection": t, "field": "k", "equals": str(k)}) for t in TYPES for k in range(100)]
    wanted += [(f"{t}-all", {"collection": t}) for t in TYPES] + [(f"{t}-text", {"collection": t, "field": "k", "equals": '"5"'}) for t in TYPES]
    specs = specs_frame(spark, [{"pipeline": p, "check": "doc_count", "threshold": 30.0, "params": params} for p, params in wanted])
    return out(evaluate(specs, filtered_counts_by_spec(table(spark, sf, "events"), specs, "event_type", "props")))


# ---------------------------------------------------------------- M20, distinct users a day from stored sketches
@query("m20_sketched_depth", sql=f"""
SELECT x AS pipeline, TRUE AS within_5_percent FROM (VALUES {_NAMES_SQL}) t(x) JOIN (SELECT DISTINCT event_type FROM events) ON event_type = x
""")
def m20_sketched_depth(spark, sf):
    """Distinct message ids per queue, merged from one written sketch per queue and day, against the exact count."""
    from vigil.session import scratch_path
    events = table(spark, sf, "events")
    path = scratch_path(spark, "queue-sketches")
    M.queue_sketches(events, "event_type", "event_id", F.to_date("ts")).write.partitionBy("part").parquet(path)
    depth = M.sketched_depth(spark.read.parquet(path))
    exact = M.queue_depth(events, "event_type", distinct="event_id").select("pipeline", F.col("value").alias("exact"))
    return depth.join(exact, "pipeline").select("pipeline", (F.abs(F.col("value") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within_5_percent"))
