"""Table schemas of the data model: specs, measures, results, channels, outbox."""

from __future__ import annotations

from pyspark.sql import types as T

SPECS = T.StructType([
    T.StructField("pipeline", T.StringType(), False),
    T.StructField("check", T.StringType(), True),
    T.StructField("op", T.StringType(), True),
    T.StructField("threshold", T.DoubleType(), True),
    T.StructField("max_threshold", T.DoubleType(), True),
    T.StructField("max_age_hours", T.DoubleType(), True),
    T.StructField("expected", T.StringType(), True),
    T.StructField("schedule", T.StringType(), True),
    T.StructField("max_duration_seconds", T.IntegerType(), True),
    T.StructField("alert_on_failure", T.BooleanType(), True),
    T.StructField("tags", T.ArrayType(T.StringType()), True),
    T.StructField("params", T.MapType(T.StringType(), T.StringType()), True),
])

# One row per (pipeline, check) that has data. ``present`` separates "a row exists
# whose value is NULL" from "no row at all" once the measures are left-joined.
MEASURES = T.StructType([
    T.StructField("pipeline", T.StringType(), True),
    T.StructField("check", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("raw", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("observed_at", T.TimestampNTZType(), True),
    T.StructField("aux", T.DoubleType(), True),
    T.StructField("present", T.BooleanType(), True),
])

RESULTS = T.StructType([
    T.StructField("pipeline", T.StringType(), True),
    T.StructField("check", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("threshold", T.DoubleType(), True),
    T.StructField("last_run", T.TimestampNTZType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("checked_at", T.TimestampNTZType(), True),
    T.StructField("tags", T.ArrayType(T.StringType()), True),
    T.StructField("alert_on_failure", T.BooleanType(), True),
])

# State of a measure whose source could not be read: unknown under every profile.
SOURCE_ERROR = "#source error"
# State of a measure whose spec lacks a required setting (named in ``raw``): unknown as well.
MISSING_SETTING = "#missing setting"
# State of a measure whose source holds records that can't be read (counted in ``raw``): unknown, too.
BAD_RECORDS = "#bad records"

OUTBOX = T.StructType([
    T.StructField("channel", T.StringType(), True),
    T.StructField("recipient", T.StringType(), True),
    T.StructField("pipeline", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("dedup_key", T.StringType(), True),
    T.StructField("payload", T.StringType(), True),
])

OFFSETS = T.StructType([
    T.StructField("topic", T.StringType(), True),
    T.StructField("partition", T.LongType(), True),
    T.StructField("end_offset", T.LongType(), True),
    T.StructField("committed", T.LongType(), True),
])

OBJECTS = T.StructType([
    T.StructField("path", T.StringType(), True),
    T.StructField("modificationTime", T.TimestampNTZType(), True),
    T.StructField("length", T.LongType(), True),
])

RUNS = T.StructType([
    T.StructField("job", T.StringType(), True),
    T.StructField("run_id", T.LongType(), True),
    T.StructField("started", T.TimestampNTZType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("life_cycle", T.StringType(), True),
    T.StructField("duration_ms", T.LongType(), True),
])
