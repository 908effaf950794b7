"""The shared checkpoint folder: read from the session, set only when missing."""

from vigil.session import ensure_checkpoint_dir, scratch_path


def test_checkpoint_dir_is_read_from_the_session(spark):
    configured = spark.sparkContext.getCheckpointDir()
    assert configured, "the test session has a checkpoint folder"
    assert ensure_checkpoint_dir(spark) == configured       # used as is, not replaced
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a.startswith(configured.rstrip("/") + "/vigil/x-") and a != b


def test_checkpoint_cuts_lineage_into_that_folder(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS twice")
    cut = df.checkpoint(eager=True)
    assert cut.count() == 10
    assert "LogicalRDD" in cut._jdf.queryExecution().optimizedPlan().toString()
