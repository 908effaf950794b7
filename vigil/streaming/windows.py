"""Structured Streaming: R1-R3.

Polled message receipt becomes a file (or Kafka) stream. Aggregation state is
bounded by the number of keys (R2, R3) or dropped behind the watermark (R1).
Every micro-batch is evaluated against the specs inside ``foreachBatch``, where
the specs can be the preserved side of a left join (a stream cannot be).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.base import as_col, to_measures
from vigil.plans.evaluate import evaluate
from vigil.session import scratch_path, use_utc


def file_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files under ``path`` (a folder or glob) as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def kafka_stream(spark: SparkSession, bootstrap_servers: str, topics: str, starting: str = "latest") -> DataFrame:
    """S9 from Kafka (needs the connector jar): records with topic, partition,
    offset and event time (the record timestamp) as columns."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
            .option("subscribe", topics).option("startingOffsets", starting).load()
            .select("topic", "partition", "offset", F.col("timestamp").cast("timestamp_ntz").alias("ts"),
                    F.col("value").cast("string").alias("value")))


def event_time(ts: str | Column) -> Column:
    """Watermarks need TIMESTAMP; wall-clock UTC TIMESTAMP_NTZ is cast in a UTC session."""
    return as_col(ts).cast("timestamp")


def window_counts(stream: DataFrame, key: str | Column, ts: str | Column, window: str = "1 day",
                  watermark: str = "10 minutes") -> DataFrame:
    """Messages per tumbling window and key; a window is emitted once the
    watermark passes its end (append mode), and later events are dropped."""
    s = stream.withColumn("_et", event_time(ts)).withWatermark("_et", watermark)
    return s.groupBy(F.window("_et", window).alias("w"), as_col(key).alias("pipeline")).agg(
        F.count(F.lit(1)).alias("n")).select(
        "pipeline", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n")


def watermark_of(query) -> dt.datetime | None:
    """The watermark a stream reached, as UTC wall clock, from its progress; None before its first event."""
    marks = [p["eventTime"]["watermark"] for p in map(as_dict, query.recentProgress) if (p.get("eventTime") or {}).get("watermark")]
    return dt.datetime.fromisoformat(max(marks).replace("Z", "+00:00")).replace(tzinfo=None) if marks else None


def as_dict(progress) -> dict:
    return progress if isinstance(progress, dict) else json.loads(progress.json)


def late_events(events: DataFrame, windows: DataFrame, closed_until: dt.datetime | Column, key: str | Column, ts: str | Column,
                window: str = "1 day") -> DataFrame:
    """What the watermark dropped, exactly. ``(pipeline, window_start, window_end, n, n_late)`` of every window that ends by
    ``closed_until``: ``n`` messages emitted by ``window_counts``, ``n_late`` more in the source ``events``. The stream's own
    counter is no measure: it counts partial aggregates, not messages. Both sides are one row per key and window before they
    meet, so a hot key costs nothing; a null key is a key. Rows without a time belong to no window. Windows
    that only late messages fell into have n = 0."""
    end = closed_until if isinstance(closed_until, Column) else F.lit(closed_until)
    held = (events.select(as_col(key).alias("pipeline"), event_time(ts).alias("_et"))
            .groupBy("pipeline", F.window("_et", window).alias("w")).agg(F.count(F.lit(1)).alias("_all"))
            .select("pipeline", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "_all")
            .where(F.col("window_end") <= end.cast("timestamp_ntz")))
    sent = windows.groupBy(F.col("pipeline").alias("_p"), F.col("window_start").alias("_w")).agg(F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return held.join(sent, F.col("pipeline").eqNullSafe(F.col("_p")) & (F.col("window_start") == F.col("_w")), "left").select(
        "pipeline", "window_start", "window_end", n.alias("n"), (F.col("_all") - n).alias("n_late"))


def late_event_measures(late: DataFrame, check: str = "late_events") -> DataFrame:
    """Dropped messages per pipeline as a measure, 0 where none was dropped."""
    agg = late.groupBy("pipeline").agg(F.sum("n_late").alias("n"), F.max("window_end").alias("upto"))
    return to_measures(agg, check, value=F.col("n"), observed_at=F.col("upto"))


def partition_progress(stream: DataFrame, topic: str | Column, partition: str | Column,
                       consumed: Column) -> DataFrame:
    """R2: running end and committed offsets per (topic, partition) of a log
    stream; state holds one row per partition."""
    return stream.groupBy(as_col(topic).cast("string").alias("topic"), as_col(partition).cast("long").alias("partition")).agg(
        F.count(F.lit(1)).alias("end_offset"), F.count_if(consumed).alias("_done")).select(
        "topic", "partition", "end_offset",
        F.when(F.col("_done") > 0, F.col("_done")).cast("long").alias("committed"))


def newest_per_key(stream: DataFrame, key: str | Column, ts: str | Column) -> DataFrame:
    """Newest event time per key; state holds one row per key."""
    return stream.groupBy(as_col(key).alias("pipeline")).agg(F.max(as_col(ts)).alias("newest"))


def evaluate_batches(specs: DataFrame, to_measures_fn: Callable[[DataFrame], DataFrame], out_path: str,
                     as_of_fn: Callable[[DataFrame], Column], defaults=None):
    """A ``foreachBatch`` function for complete-mode aggregates: each batch holds
    the whole (key-bounded) state, so its measures are evaluated against every
    spec (left join from the specs, in batch) and the results overwrite
    ``out_path``. Re-running a batch after a failure rewrites the same answer."""
    def run(batch: DataFrame, batch_id: int) -> None:
        measures = to_measures_fn(batch)
        results = evaluate(specs, measures, as_of=as_of_fn(batch), defaults=defaults)
        results.write.mode("overwrite").parquet(out_path)
    return run


def run_available(query_builder, spark: SparkSession, name: str, checkpoint: str | None = None):
    """Start a stream with ``trigger(availableNow=True)``, checkpointing under the
    shared checkpoint folder (or in ``checkpoint``, to go on where an earlier run
    ended), and wait for it to drain the available input."""
    use_utc(spark)
    ckpt = checkpoint or scratch_path(spark, f"stream-{name}")
    q = query_builder.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def window_count_measures(windows: DataFrame, check: str = "messages_in_window") -> DataFrame:
    """Window counts as measures keyed by ``pipeline@window_start``."""
    key = F.concat(F.col("pipeline"), F.lit("@"), F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss"))
    return to_measures(windows, check, pipeline=key, value=F.col("n"), observed_at=F.col("window_end"))


def alert_batches(specs_of: Callable[[DataFrame], DataFrame], measures_of: Callable[[DataFrame], DataFrame],
                  channels, out_path: str, as_of_fn: Callable[[DataFrame], Column], alert_on_healthy: bool = False):
    """A ``foreachBatch`` function that evaluates each micro-batch and writes its
    alert outbox to ``out_path/batch=<id>`` (S10 under streaming). Specs may be
    derived from the batch itself (e.g. one per closed window). A replayed batch
    overwrites its own folder."""
    from vigil.plans.alerts import route_alerts

    def run(batch: DataFrame, batch_id: int) -> None:
        results = evaluate(specs_of(batch), measures_of(batch), as_of=as_of_fn(batch))
        outbox = route_alerts(results, channels, alert_on_healthy=alert_on_healthy)
        outbox.write.mode("overwrite").json(f"{out_path.rstrip('/')}/batch={batch_id}")
    return run
