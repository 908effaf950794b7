"""Run reports E4, E5, E8 (E3 and E6 live with the evaluation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.status import is_healthy


def run_report(results: DataFrame, outbox: DataFrame | None = None) -> DataFrame:
    """One row (total, healthy, unhealthy, alerts_sent, exit_code). A channel that
    writes to several recipients sends one alert per result.

    Results and outbox rows are tagged and unioned into one global aggregate, so
    the report needs no join; every task pre-aggregates to one row."""
    r = results.select(F.lit(1).alias("_r"), is_healthy(F.col("status")).alias("_h"), F.lit(None).cast("string").alias("_to"))
    u = r
    if outbox is not None:
        u = r.unionByName(outbox.select(F.lit(0).alias("_r"), F.lit(False).alias("_h"), F.when(
            F.col("recipient").isNotNull(), F.to_json(F.struct("channel", "pipeline", "dedup_key"))).alias("_to")))
    agg = u.agg(
        F.coalesce(F.sum("_r"), F.lit(0)).cast("long").alias("total"),
        F.count_if((F.col("_r") == 1) & F.col("_h")).alias("healthy"),
        (F.count_if((F.col("_r") == 0) & F.col("_to").isNull()) + F.count_distinct("_to")).alias("alerts_sent"),
    )
    return agg.select(
        "total", "healthy", (F.col("total") - F.col("healthy")).alias("unhealthy"), "alerts_sent",
        F.when(F.col("total") - F.col("healthy") > 0, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"),
    )


def summary_text() -> Column:
    """E5: ``Checked N pipeline(s): H healthy, U unhealthy. Alerts sent: A.``"""
    return F.format_string("Checked %d pipeline(s): %d healthy, %d unhealthy. Alerts sent: %d.",
                           F.col("total"), F.col("healthy"), F.col("unhealthy"), F.col("alerts_sent"))


def tag_report(results: DataFrame) -> DataFrame:
    """Results per (tag, status) with subtotals per tag and a grand total
    (``rollup``). Untagged results count under a NULL tag; the rollup's own
    subtotal rows are marked by ``level``."""
    tagged = results.select(F.explode_outer("tags").alias("tag"), "status")
    return tagged.rollup("tag", "status").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
