"""Upsert log of stream state, and stored sketches of distinct counts."""

from pyspark.sql import functions as F

from vigil import operators as M
from vigil.session import scratch_path
from vigil.streaming import StateLog

SCHEMA = "k string, n long"


def held(log, spark):
    found = log.read(spark)
    return None if found is None else {r["k"]: r["n"] for r in found.collect()}


def test_a_trigger_writes_the_changed_keys_only(spark):
    log = StateLog(scratch_path(spark, "test-log"), ["k"])
    assert held(log, spark) is None
    log.compact(spark)
    log.append(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], SCHEMA), 0)
    log.append(spark.createDataFrame([("b", 2)], SCHEMA), 1)
    log.append(spark.createDataFrame([], SCHEMA), 2)
    assert [(r["batch"], r["kind"], r["n"]) for r in log.commits(spark)] == [(0, "delta", 3), (1, "delta", 1), (2, "delta", 0)]
    assert held(log, spark) == {"a": 1, "b": 2, "c": 1}
    log.append(spark.createDataFrame([("b", 3), ("d", 1)], SCHEMA), 2)  # a replayed batch replaces itself
    assert held(log, spark) == {"a": 1, "b": 3, "c": 1, "d": 1}


def test_a_batch_counts_once_it_is_committed(spark):
    log = StateLog(scratch_path(spark, "test-log"), ["k"])
    log.append(spark.createDataFrame([("a", 1)], SCHEMA), 0)
    before = log.read(spark)
    spark.createDataFrame([("a", 9)], SCHEMA).withColumn("_batch", F.lit(1).cast("long")).write.parquet(f"{log.path}/delta/1")  # died before its commit
    assert held(log, spark) == {"a": 1}
    log.append(spark.createDataFrame([("a", 2)], SCHEMA), 1)
    assert held(log, spark) == {"a": 2} and [r["n"] for r in before.collect()] == [1]  # a reader keeps its version


def test_compaction_changes_no_answer(spark):
    log = StateLog(scratch_path(spark, "test-log"), ["k"], compact_every=2)
    for i in range(5):
        log.append(spark.createDataFrame([("a", i), (f"k{i}", i)], SCHEMA), i)
    assert [r["batch"] for r in log.commits(spark) if r["kind"] == "base"] == [1, 3]
    want = {"a": 4, **{f"k{i}": i for i in range(5)}}
    assert held(log, spark) == want
    assert len(log.read(spark).inputFiles()) < len(spark.read.parquet(f"{log.path}/delta/*").inputFiles())
    log.compact(spark)
    log.compact(spark)
    assert held(log, spark) == want


def test_sketches_merge_over_days(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("q"), (F.col("id") % 2).cast("string")).alias("q"), (F.col("id") % 15_000).alias("m"), (F.col("id") % 7).alias("day"))
    sketches = M.queue_sketches(rows, "q", "m", "day")
    assert sketches.count() == 14
    exact = {r["pipeline"]: r["value"] for r in M.queue_depth(rows, "q", distinct="m").collect()}
    got = {r["pipeline"]: r["value"] for r in M.sketched_depth(sketches).collect()}
    assert set(got) == set(exact) and all(abs(got[q] - exact[q]) <= 0.05 * exact[q] for q in exact)
    assert M.sketched_depth(sketches.where("day = 99")).collect() == []
