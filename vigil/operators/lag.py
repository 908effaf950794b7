"""Lag, backlog and task family: M16-M19, M21, M22."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.base import as_col, micros_between, to_measures


def total_lag(offsets: DataFrame, topic: str | Column = "topic", end: str | Column = "end_offset",
              committed: str | Column = "committed", check: str = "total_lag") -> DataFrame:
    """Sum over partitions of max(end - committed, 0); a partition with no
    committed offset counts from 0. The coalesce comes before the subtraction:
    ``greatest`` skips NULLs, so ``greatest(end - NULL, 0)`` would read as 0."""
    lag = F.greatest(as_col(end) - F.coalesce(as_col(committed), F.lit(0)), F.lit(0))
    agg = offsets.groupBy(as_col(topic).alias("pipeline")).agg(F.sum(lag).alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def total_lag_received(offsets: DataFrame, topic: str | Column = "topic", end: str | Column = "end_offset",
                       last_read: str | Column = "last_read", check: str = "total_lag_received") -> DataFrame:
    """As M16, but a partition never read counts as caught up (lag 0)."""
    e = as_col(end)
    lag = F.greatest(e - F.coalesce(as_col(last_read), e), F.lit(0))
    agg = offsets.groupBy(as_col(topic).alias("pipeline")).agg(F.sum(lag).alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def max_lag_ms(shards: DataFrame, stream: str | Column = "stream", lag: str | Column = "lag_ms",
               check: str = "max_lag_ms") -> DataFrame:
    """The largest lag over a stream's shards; a shard without a lag counts 0.
    A stream with no shards has no row (unknown)."""
    agg = shards.groupBy(as_col(stream).alias("pipeline")).agg(F.max(F.coalesce(as_col(lag), F.lit(0))).alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def shard_lags(log: DataFrame, stream: str | Column, shard: str | Column, ts: str | Column, as_of: Column) -> DataFrame:
    """Per (stream, shard): milliseconds from the newest record to ``as_of``."""
    agg = log.groupBy(as_col(stream).alias("stream"), as_col(shard).alias("shard")).agg(F.max(as_col(ts)).alias("newest"))
    return agg.select("stream", "shard", (micros_between(F.col("newest"), as_of) / F.lit(1000)).cast("long").alias("lag_ms"))


def backlog(produced: DataFrame, acked: DataFrame, on: str | list[str], key: str | Column,
            check: str = "backlog") -> DataFrame:
    """Messages produced and never acknowledged, per queue (0 when all are).

    The acknowledged ids are made distinct and left-joined on the id; both sides
    are shuffled on the id (high cardinality, so no hot partition), the distinct
    and the join share that partitioning, and AQE broadcasts the ack side when it
    measures small. Every queue with messages gets a row, pending or not."""
    keys = [on] if isinstance(on, str) else list(on)
    acks = acked.select(*keys).distinct().withColumn("_acked", F.lit(True))
    joined = produced.join(acks, on=keys, how="left")
    agg = joined.groupBy(as_col(key).alias("pipeline")).agg(F.count_if(F.col("_acked").isNull()).alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def backlog_until(produced: DataFrame, acks: DataFrame, match: str, ts: str, key: str | Column,
                  check: str = "backlog", salt: int = 1) -> DataFrame:
    """M19 where an acknowledgement is any later ack event of the same ``match``
    key (e.g. a user's purchase after a signup). Acks are first reduced to their
    newest time per match key, so the join meets one ack row per key instead of
    pairing every message with every ack; a message is pending when no ack exists
    at or after it.

    A hot match key on the message side is split by AQE's skew join. ``salt > 1``
    splits it explicitly as well: each message gets a deterministic bucket in
    [0, salt) from a hash of its row (so a retried task rebuilds the same
    buckets), and the one-row-per-key ack side is copied once per bucket, so a
    key holding a third of the messages is spread over ``salt`` tasks."""
    newest_ack = acks.groupBy(match).agg(F.max(ts).alias("_acked_until"))
    on = [match]
    if salt > 1:
        produced = produced.withColumn("_salt", F.pmod(F.xxhash64(*produced.columns), F.lit(salt)).cast("int"))
        newest_ack = newest_ack.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on = [match, "_salt"]
    joined = produced.join(newest_ack, on=on, how="left")
    pending = F.col("_acked_until").isNull() | (F.col(ts) > F.col("_acked_until"))
    agg = joined.groupBy(as_col(key).alias("pipeline")).agg(F.count_if(pending).alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def active_tasks(workers: DataFrame, tasks: str | Column = "tasks", check: str = "active_tasks") -> DataFrame:
    """Active tasks per queue. ``tasks`` is a map worker -> list of tasks with
    ``delivery_info.routing_key`` / ``delivery_info.exchange``. A task counts for a
    queue named by either field, once even when both name it."""
    per_worker = workers.select(F.explode(F.map_values(as_col(tasks))).alias("task_list"))
    flat = per_worker.select(F.explode("task_list").alias("task"))
    names = F.array_distinct(F.filter(
        F.array(F.col("task.delivery_info.routing_key"), F.col("task.delivery_info.exchange")),
        lambda x: x.isNotNull()))
    queues = flat.select(F.explode(names).alias("pipeline"))
    agg = queues.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def messages_in_window(messages: DataFrame, key: str | Column, as_of: Column, seconds: float,
                       ts: str | Column = "ts", check: str = "messages_in_window") -> DataFrame:
    """Messages received in [as_of - seconds, as_of), per topic."""
    t = as_col(ts)
    start = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)))
    agg = messages.where((t >= start) & (t < as_of)).groupBy(as_col(key).alias("pipeline")).agg(
        F.count(F.lit(1)).alias("n"))
    return to_measures(agg, check, value=F.col("n"))
