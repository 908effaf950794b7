"""End and committed offsets per (topic, partition)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.base import as_col


def offsets_from_log(log: DataFrame, topic: str | Column, partition: str | Column, consumed: Column) -> DataFrame:
    """Offsets of a message log: a partition's records have offsets 0..n-1, so the
    end offset is n and the committed offset is the number of records the
    consumer has processed (``consumed`` true); NULL when it processed none (no
    committed offset). One partial aggregate per (topic, partition)."""
    agg = log.groupBy(as_col(topic).cast("string").alias("topic"), as_col(partition).cast("long").alias("partition")).agg(
        F.count(F.lit(1)).alias("end_offset"),
        F.count_if(consumed).alias("_done"),
    )
    return agg.select("topic", "partition", "end_offset",
                      F.when(F.col("_done") > 0, F.col("_done")).cast("long").alias("committed"))


def kafka_end_offsets(spark: SparkSession, bootstrap_servers: str, topics: str) -> DataFrame:
    """End offsets read with the Kafka batch source (needs the connector jar):
    one aggregate over the topic's records, no consumer group involved."""
    records = spark.read.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers) \
        .option("subscribe", topics).option("startingOffsets", "earliest").option("endingOffsets", "latest").load()
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
