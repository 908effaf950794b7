"""The upsert queries' input: written by as many tasks as read it, every row once, five triggers."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from suite.q_stream import _events_in_parts
from vigil.session import ensure_checkpoint_dir, scratch_path
from vigil.streaming import run_available

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("files, rows", [(3, 300), (1, 40), (1, 0)])
def test_events_in_parts(spark, tmp_path, files, rows):
    at = dt.datetime(2024, 1, 2)
    events = [(i // 2, at + dt.timedelta(minutes=i // 2), i % 7 or None, None if i % 11 == 0 else "view", 1.0, "{}") for i in range(rows)]
    spark.createDataFrame(events, EVENT).repartition(files).write.parquet(f"{tmp_path}/events.parquet")
    before = set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/vigil/events-in-parts-*"))
    stream = _events_in_parts(spark, str(tmp_path))
    folder, = set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/vigil/events-in-parts-*")) - before
    if files > 1:  # no part in the hands of one task
        assert all(len(glob.glob(f"{folder}/{i}/*.parquet")) > 1 for i in range(5))
    out = scratch_path(spark, "parts-out")
    query = run_available(stream.writeStream.format("parquet").option("path", out).outputMode("append"), spark, "parts")
    assert sum(1 for p in query.recentProgress if p["numInputRows"]) <= 5
    back = spark.read.schema(EVENT).parquet(out)
    assert sorted(map(str, back.collect())) == sorted(map(str, spark.createDataFrame(events, EVENT).select(*back.columns).collect()))
    assert back.select(F.count("*")).first()[0] == rows
