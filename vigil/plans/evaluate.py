"""Evaluation: every spec row gets exactly one result row, in one job.

``evaluate(specs, measures)`` left-joins the specs to the measures on
(pipeline, check) and derives status, value, threshold and message with one
column expression that dispatches on the spec's ``op``. Specs of different ops
and checks are evaluated together; nothing loops over pipelines.

Join plan: measures are already aggregated to one row per (pipeline, check), so
both sides are small next to the data they came from. No broadcast is forced:
AQE measures the shuffled sides at runtime and broadcasts only a side under
``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise it is a sort-merge
join on the pipeline key.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import verdicts as V
from vigil.functions.numbers import num_text
from vigil.functions.profiles import coerce
from vigil.functions.status import OK, UNKNOWN, WARNING
from vigil.schema import BAD_RECORDS, MEASURES, MISSING_SETTING, SOURCE_ERROR

NUMERIC_OPS = ("ge", "gt", "le", "le_any", "between", "max_age", "count_recent", "eq")
STATE_OPS = ("state_airflow", "state_dbt", "state_databricks", "completed", "truthy", "http", "static")
OPS = NUMERIC_OPS + STATE_OPS
RUN_OPS = ("state_airflow", "state_dbt", "state_databricks", "completed")


def as_of_lit(as_of) -> Column:
    """A fixed evaluation time as TIMESTAMP_NTZ (UTC wall clock)."""
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of.replace("Z", ""))
    if isinstance(as_of, _dt.datetime) and as_of.tzinfo is not None:
        as_of = as_of.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    # as text: Spark reads a datetime literal in the time zone of the driver's process
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def _param(name: str) -> Column:
    return F.element_at(F.coalesce(F.col("params"), F.create_map().cast("map<string,string>")), F.lit(name))


def _source_default(defaults: Mapping[str, float] | None) -> Column:
    """Per-check default threshold (the source-level setting of V15)."""
    expr = F.lit(None).cast("double")
    for check, value in (defaults or {}).items():
        expr = F.when(F.col("check") == F.lit(check), F.lit(float(value))).otherwise(expr)
    return expr


def _op_default(op: Column) -> Column:
    expr = F.lit(None).cast("double")
    for name, value in V.DEFAULT_THRESHOLD.items():
        if value is not None:
            expr = F.when(op == F.lit(name), F.lit(value)).otherwise(expr)
    return expr


def _msg(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def evaluate(specs: DataFrame, measures: DataFrame, as_of=None, defaults: Mapping[str, float] | None = None) -> DataFrame:
    """E2 + V1-V15 + E9: results for every spec, in the RESULTS schema.

    Three projections: inputs (coerced value, threshold chain), then status and
    number texts, then messages. Each stage refers to the previous one's columns,
    so the coerced value is computed once per row instead of being inlined into
    every branch of the status and message expressions. The stage expressions
    name columns only, so they are built once per JVM and reused."""
    j = specs.join(measures, on=["pipeline", "check"], how="left")
    inputs, stage2, final = _stages(defaults)
    # The inputs come out of a one-element generator rather than a projection: a
    # filter on status or message written by the caller is then pushed down no
    # further than these columns, instead of having every alias inlined into one
    # condition (which would repeat the coerced value dozens of times).
    # The spec's own columns stay outside it, so a filter on them reaches the scans.
    s1 = j.select(*inputs[:5], F.inline(F.array(F.struct(*inputs[5:]))))
    s2 = s1.select("*", *stage2)
    return s2.select(*final[:8], as_of_lit(as_of).alias("checked_at"), *final[8:])


_STAGES: dict = {}


def _stages(defaults: Mapping[str, float] | None):
    from pyspark import SparkContext
    key = (id(SparkContext._gateway), tuple(sorted((defaults or {}).items())))
    if key not in _STAGES:
        _STAGES[key] = _build_stages(defaults)
    return _STAGES[key]


def _build_stages(defaults: Mapping[str, float] | None):
    # -- stage 1: inputs
    op_ = F.coalesce(F.col("op"), F.lit("ge"))
    profile = _param("profile")
    zero_unset = F.coalesce(_param("zero_is_unset") == F.lit("true"), F.lit(False))
    failed_ = F.coalesce(F.col("state").isin(SOURCE_ERROR, MISSING_SETTING, BAD_RECORDS), F.lit(False))
    v_, reason_ = coerce(F.col("value"), F.col("raw"), F.col("present"), profile)
    v_, reason_ = F.when(~failed_, v_), F.when(
        F.col("state") == F.lit(MISSING_SETTING), _msg("missing setting '", F.col("raw"), "'")).when(
        F.col("state") == F.lit(BAD_RECORDS), F.col("raw")).when(failed_, F.lit("source error")).otherwise(reason_)
    t_ = V.threshold_chain(F.col("threshold"), _source_default(defaults), _op_default(op_), zero_unset)
    inputs = [
        F.col("pipeline"), F.col("check"), F.col("tags"), F.col("alert_on_failure"), F.col("params"),
        op_.alias("_op"), failed_.alias("_failed"),
        F.coalesce(F.col("present"), F.lit(False)).alias("_present"),
        F.coalesce(_param("label"), F.col("check")).alias("_label"),
        v_.alias("_v"), reason_.alias("_reason"), t_.alias("_t"),
        F.coalesce(F.col("max_age_hours"), F.lit(V.DEFAULT_THRESHOLD["max_age"])).alias("_hours"),
        F.col("max_age_hours").alias("_max_age"),
        F.col("max_threshold").alias("_hi"),
        F.col("expected").try_cast("double").alias("_exp_own"),
        F.col("max_duration_seconds").cast("double").alias("_max_s"),
        _param("json_path").isNotNull().alias("_has_path"),
        _param("default_status").alias("_default_status"),
        F.col("value").alias("_mv"), F.col("raw").alias("_raw"), F.col("state").alias("_state"),
        F.col("aux").alias("_aux"), F.col("observed_at").alias("_observed"),
    ]
    # -- stage 2: status and number texts
    op, v, t, mv, state, raw = (F.col(c) for c in ("_op", "_v", "_t", "_mv", "_state", "_raw"))
    present, hours, hi = F.col("_present"), F.col("_hours"), F.col("_hi")
    expected = F.coalesce(F.col("_exp_own"), t)
    num_status = (
        F.when(op == "ge", V.verdict_ge(v, t))
        .when(op == "gt", V.verdict_gt(v, t))
        .when(op == "le", V.verdict_le(v, t))
        .when(op == "le_any", V.verdict_le_any(v, t))
        .when(op == "between", V.verdict_between(v, t, hi))
        .when(op == "max_age", V.verdict_max_age(v, hours))
        .when(op == "count_recent", V.verdict_count_recent(v, t, F.col("_aux"), F.col("_max_age")))
        .when(op == "eq", F.when(expected.isNull(), F.lit(UNKNOWN)).otherwise(V.verdict_eq(v, expected)))
    )
    completed = F.lower(state) == F.lit("true")
    st_status = (
        F.when(op == "static", V.verdict_static(present, state, F.coalesce(F.col("_default_status"), F.lit(OK))))
        .when(~present, F.lit(UNKNOWN))
        .when(op == "state_airflow", V.verdict_state_airflow(state))
        .when(op == "state_dbt", V.verdict_state_dbt(state))
        .when(op == "state_databricks", V.verdict_state_databricks(raw, state))
        .when(op == "completed", V.verdict_completed(completed, mv))
        .when(op == "truthy", V.verdict_truthy(state))
        .when(op == "http", V.verdict_http(mv, expected, state, F.col("_has_path")))
    )
    is_numeric = op.isin(*NUMERIC_OPS)
    base_status = F.when(F.col("_failed"), F.lit(UNKNOWN)).when(is_numeric, num_status).when(op.isin(*STATE_OPS), st_status).otherwise(F.lit(UNKNOWN))
    stage2 = [
        base_status.alias("_base_status"),
        expected.alias("_exp"),
        num_text(v).alias("_vt"), num_text(t).alias("_tt"), num_text(hours).alias("_ht"),
        num_text(expected).alias("_et"), num_text(mv).alias("_mvt"), num_text(hi).alias("_hit"),
        num_text(F.col("_max_age")).alias("_mat"),
    ]

    # -- stage 3: messages, E9, output
    label, vt, tt, ht, et, mvt = (F.col(c) for c in ("_label", "_vt", "_tt", "_ht", "_et", "_mvt"))
    expected = F.col("_exp")
    ok_ = F.col("_base_status") == F.lit(OK)
    reason = F.col("_reason")
    unknown_msg = (
        F.when(reason == "non-numeric", _msg(label, ": non-numeric value '", F.coalesce(raw, mvt), "'"))
        .otherwise(_msg(label, ": ", reason))
    )
    num_msg = (
        F.when((op == "eq") & expected.isNull(), _msg(label, ": missing setting 'expected'"))
        .when(v.isNull(), unknown_msg)
        .when(op == "ge", F.when(ok_, _msg(label, " ", vt, " meets threshold ", tt)).otherwise(_msg(label, " ", vt, " below threshold ", tt)))
        .when(op == "gt", F.when(ok_, _msg(label, " ", vt, " above threshold ", tt)).otherwise(_msg(label, " ", vt, " not above threshold ", tt)))
        .when(op == "le", F.when(ok_, _msg(label, " ", vt, " within threshold ", tt)).otherwise(_msg(label, " ", vt, " exceeds threshold ", tt)))
        .when(op == "le_any", F.when(ok_ & (t == F.lit(-1.0)), _msg(label, " ", vt, ", any value accepted"))
              .when(ok_, _msg(label, " ", vt, " within threshold ", tt)).otherwise(_msg(label, " ", vt, " exceeds threshold ", tt)))
        .when(op == "between", F.when(ok_, _msg(label, " ", vt, " within bounds"))
              .when(v < t, _msg(label, " ", vt, " below minimum ", tt))
              .otherwise(_msg(label, " ", vt, " above maximum ", F.col("_hit"))))
        .when(op == "max_age", F.when(ok_, _msg(label, " ", vt, "h old, within ", ht, "h")).otherwise(_msg(label, " ", vt, "h old, exceeds ", ht, "h")))
        .when(op == "count_recent", F.when(ok_, _msg(label, " ", vt, " meets threshold ", tt))
              .when(F.isnan(v) | ~(v >= t), _msg(label, " ", vt, " below threshold ", tt))
              .otherwise(_msg(label, " ", vt, ", none modified within ", F.col("_mat"), "h")))
        .when(op == "eq", F.when(ok_, _msg(label, " ", vt, " equals expected ", et)).otherwise(_msg(label, " ", vt, ", expected ", et)))
    )
    has_path = F.col("_has_path")
    st_msg = (
        F.when(op == "static", F.coalesce(F.when(present, raw), _msg("Static check for ", F.col("pipeline"))))
        .when(~present, _msg(label, ": no data"))
        .when(op.isin("state_airflow", "state_dbt"), _msg(label, " state=", F.coalesce(state, F.lit("null"))))
        .when(op == "state_databricks", F.when(F.coalesce(raw == F.lit(V.DATABRICKS_TERMINAL), F.lit(False)), _msg(label, " result=", F.coalesce(state, F.lit("null"))))
              .otherwise(_msg(label, " not terminated (life_cycle=", F.coalesce(raw, F.lit("null")), ")")))
        .when(op == "completed", F.when(~F.coalesce(completed, F.lit(False)), _msg(label, " attempt not completed"))
              .otherwise(_msg(label, " completed in ", mvt, " ms")))
        .when(op == "truthy", F.when(state.isNull(), _msg(label, ": path not found")).otherwise(_msg(label, " value is ", state)))
        .when(op == "http", F.when(mv.isNull(), _msg(label, ": no data"))
              .when(mv != expected, _msg(label, " expected ", et, ", got ", mvt))
              .when(has_path & state.isNull(), _msg(label, ": path not found"))
              .when(has_path & (state == F.lit("falsy")), _msg(label, " path resolved to falsy value"))
              .otherwise(_msg(label, " ", mvt, " OK")))
    )
    default_message = F.when(F.col("_failed"), unknown_msg).when(is_numeric, num_msg).when(op.isin(*STATE_OPS), st_msg).otherwise(
        _msg(label, ": unsupported op ", op))
    # A spec may phrase its own messages (params message_ok / message_fail) with
    # {pipeline} {label} {value} {threshold} placeholders; unknown results keep the
    # built-in text, which says why.
    template = F.when(ok_, _param("message_ok")).when(F.col("_base_status") != F.lit(UNKNOWN), _param("message_fail"))
    filled = template
    for token, text in (("{pipeline}", F.col("pipeline")), ("{label}", label), ("{value}", vt), ("{threshold}", tt)):
        filled = F.replace(filled, F.lit(token), F.coalesce(text, F.lit("null")))
    base_message = F.coalesce(filled, default_message)

    # A run that finished ok but took longer than max_duration_seconds is a warning.
    max_s = F.col("_max_s")
    over = (op.isin(*RUN_OPS) & ok_ & max_s.isNotNull() & F.coalesce(mv > max_s * F.lit(1000.0), F.lit(False)))
    status = F.when(over, F.lit(WARNING)).otherwise(F.col("_base_status"))
    message = F.when(over, _msg(base_message, "; run took ", num_text(mv / F.lit(1000.0)), " s, over ",
                                num_text(max_s), " s")).otherwise(base_message)
    value = F.when(is_numeric, v).otherwise(mv)
    threshold = (
        F.when(op == "max_age", hours)
        .when(op.isin("eq", "http"), expected)
        .when(is_numeric, t)
        .otherwise(F.lit(None).cast("double"))
    )
    metadata = F.when(op == "static", F.create_map(F.lit("backend"), F.lit("static"))).otherwise(
        F.coalesce(F.col("params"), F.create_map().cast("map<string,string>"))
    )
    final = [
        F.col("pipeline"),
        F.col("check"),
        status.alias("status"),
        value.cast("double").alias("value"),
        threshold.cast("double").alias("threshold"),
        F.col("_observed").cast("timestamp_ntz").alias("last_run"),
        message.alias("message"),
        metadata.alias("metadata"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.col("alert_on_failure"), F.lit(True)).alias("alert_on_failure"),
    ]
    return inputs, stage2, final


def check_all(specs: DataFrame, measures: list[DataFrame] | DataFrame, as_of=None, defaults=None) -> DataFrame:
    """Measures of several checks unioned by name, then one evaluation."""
    if isinstance(measures, DataFrame):
        frames = [measures]
    else:
        frames = list(measures)
    union = frames[0].select(*MEASURES.fieldNames())
    for frame in frames[1:]:
        union = union.unionByName(frame.select(*MEASURES.fieldNames()))
    return evaluate(specs, union, as_of=as_of, defaults=defaults)


def healthy(results: DataFrame) -> DataFrame:
    """Adds ``healthy`` (status is ok)."""
    return results.withColumn("healthy", F.coalesce(F.col("status") == F.lit(OK), F.lit(False)))


def result_line(results: DataFrame) -> Column:
    """``[STATUS] pipeline (last_run=ISO or N/A): message``."""
    ts = F.col("last_run")
    iso = F.when(
        F.date_format(ts, "SSSSSS") == F.lit("000000"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.concat(
        F.lit("["), F.upper(F.col("status")), F.lit("] "), F.col("pipeline"),
        F.lit(" (last_run="), F.coalesce(iso, F.lit("N/A")), F.lit("): "), F.coalesce(F.col("message"), F.lit("")),
    )


