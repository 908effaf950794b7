"""Relational and warehouse tables as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


def jdbc_source(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
                partition_column: str | None = None, lower_bound: int | None = None, upper_bound: int | None = None,
                num_partitions: int | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """A relational source. A small metric query goes as ``query`` (the server
    computes it); a big table goes as ``table`` split into ``num_partitions``
    range reads on ``partition_column``, with filters and aggregates pushed to the
    server by the JDBC V2 pushdown. Needs the driver jar on the classpath."""
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query or table")
    reader = spark.read.format("jdbc").option("url", url).option("pushDownAggregate", "true") \
        .option("pushDownPredicate", "true").option("pushDownLimit", "true")
    if query is not None:
        reader = reader.option("query", query)
    else:
        reader = reader.option("dbtable", table)
        if partition_column is not None:
            if lower_bound is None or upper_bound is None or num_partitions is None:
                raise ValueError("partitioned reads need lower_bound, upper_bound and num_partitions")
            reader = reader.option("partitionColumn", partition_column).option("lowerBound", str(lower_bound)) \
                .option("upperBound", str(upper_bound)).option("numPartitions", str(num_partitions))
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.load()


def table_source(spark: SparkSession, name_or_path: str, fmt: str | None = None) -> DataFrame:
    """A catalog table by name, or files of a format by path."""
    if fmt is None:
        return spark.table(name_or_path)
    return spark.read.format(fmt).load(name_or_path)


_SCHEMAS: dict = {}


def parquet_table(spark: SparkSession, path: str, refresh: bool = False) -> DataFrame:
    """Parquet files at ``path`` with their schema read once per process (as a
    catalog would supply it): later reads skip footer inference and only list
    files. ``refresh=True`` re-reads the schema after it evolved."""
    if refresh or path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def register_views(spark: SparkSession, base: str, names: Iterable[str]) -> None:
    """Parquet tables under ``base`` as temporary views (for SQL-string checks)."""
    for name in names:
        parquet_table(spark, f"{base.rstrip('/')}/{name}.parquet").createOrReplaceTempView(name)
