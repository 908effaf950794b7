"""JSON documents, as files or as a text column of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.jsonpath import json_path
from vigil.sources.records import Records, json_records


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> Records:
    """Documents of JSON line files and, apart, the lines that are none (``records.unless_bad`` makes their checks unknown)."""
    return json_records(spark, path, schema)


def json_field(doc: str | Column, dotted: str) -> Column:
    """A field of a JSON text column as text (numbers as their JSON text)."""
    d = F.col(doc) if isinstance(doc, str) else doc
    return F.get_json_object(d, json_path(dotted))


def parse_documents(df: DataFrame, doc: str, schema: str) -> DataFrame:
    """Typed fields from a JSON text column; unparsable documents give NULL fields."""
    return df.withColumn("_doc", F.from_json(F.col(doc), schema))
