"""The alert outbox sink (the table of what would be sent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_outbox(outbox: DataFrame, path: str, mode: str = "append") -> None:
    """JSON files partitioned by channel; each channel's sender reads its folder."""
    outbox.write.mode(mode).partitionBy("channel").json(path)


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Results as Parquet partitioned by evaluation time (a run per folder)."""
    results.withColumn("run", F.date_format("checked_at", "yyyyMMdd'T'HHmmss")).write.mode(mode) \
        .partitionBy("run").parquet(path)


def outbox_batch_writer(path: str):
    """``foreachBatch`` function writing each micro-batch's outbox to the sink;
    re-running a batch id after a failure rewrites that batch's own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("channel").json(f"{path.rstrip('/')}/batch={batch_id}")
    return write
