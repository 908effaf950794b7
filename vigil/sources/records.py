"""Line-delimited JSON with its bad lines kept: a broken export must not read as a smaller one.

Every line is parsed once. ``Records.good`` holds the parsed records, ``Records.bad`` the file and text of
each line that is no JSON object of the schema. ``unless_bad`` puts the count of bad lines before a
check's measures: a source with bad lines is unknown for all its pipelines, since a line that
cannot be read cannot be told to be of another pipeline.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.schema import BAD_RECORDS, MEASURES

CORRUPT = "_corrupt_record"


class Records(NamedTuple):
    good: DataFrame
    bad: DataFrame


def json_records(spark: SparkSession, path: str, schema: str | None = None) -> Records:
    """The lines of JSON files (blank lines are none). Without a ``schema`` it is inferred from the lines that
    are objects, in a pass of its own. ``good`` has the schema's fields and ``_file``; ``bad`` has ``_file`` and ``record``."""
    lines = spark.read.text(path).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("_file")).where("trim(record) <> ''")
    if schema is None:
        objects = lines.where(F.schema_of_variant(F.try_parse_json("record")).startswith("OBJECT"))
        inferred = objects.agg(F.schema_of_variant_agg(F.try_parse_json("record")).alias("s")).first()["s"] or "OBJECT<>"
        schema = _struct_of(inferred)
    return split_records(lines, schema)


def _struct_of(variant_schema: str) -> str:
    """The schema of variant objects as a struct of columns; fields without a type are text."""
    body = variant_schema.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    return body if body.startswith("STRUCT<") else "STRUCT<>"


def split_records(lines: DataFrame, schema: str, line: str = "record") -> Records:
    """Text lines of a table (``line`` and any other columns) as good records (fields of the schema and the other
    columns) and bad lines (all columns)."""
    if schema.upper().startswith("STRUCT<"):
        fields = schema[len("STRUCT<"):-1]
        kind = f"STRUCT<{fields}{', ' if fields else ''}{CORRUPT}: STRING>"
    else:
        kind = f"{schema}{', ' if schema else ''}{CORRUPT} STRING"
    whole = F.from_json(F.col(line), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = lines.withColumn("_parsed", whole)
    broken = F.col("_parsed").isNull() | F.col(f"_parsed.{CORRUPT}").isNotNull() | ~F.coalesce(
        F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))
    others = [c for c in lines.columns if c != line]
    return Records(parsed.where(~broken).select("_parsed.*", *others).drop(CORRUPT), parsed.where(broken).select(*lines.columns))


def bad_count(bad: DataFrame) -> DataFrame:
    """One row: the number of bad lines."""
    return bad.agg(F.count(F.lit(1)).alias("n_bad"))


def unless_bad(measures: DataFrame, bad: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A source's measures, each marked ``BAD_RECORDS`` with the count if it has bad lines. ``names(pipeline, check)``
    are the specs that need a row even where the good lines give none."""
    columns = MEASURES.fieldNames()
    if names is not None:
        measures = names.select("pipeline", "check").distinct().join(measures, ["pipeline", "check"], "left").select(*columns)
    told = measures.withColumn("n_bad", bad_count(bad).scalar())  # one number, counted once
    spoilt = F.col("n_bad") > 0

    def field(name: str) -> Column:
        new = {"state": F.lit(BAD_RECORDS), "raw": F.concat(F.col("n_bad").cast("string"), F.lit(" bad records")), "present": F.lit(True)}.get(name, F.lit(None))
        return F.when(spoilt, new).otherwise(F.col(name)).cast(MEASURES[name].dataType).alias(name)
    kept = told.where(spoilt | F.coalesce("present", F.lit(False)))  # without bad lines a missing row stays missing
    return kept.select("pipeline", "check", *[field(c) for c in columns if c not in ("pipeline", "check")])
