"""Quickstart: specs -> measures -> results -> outbox -> report on the sf0.001 tables.

    python examples/quickstart.py [/root/testdata/sf0.001]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from vigil import operators as M  # noqa: E402
from vigil.plans import specs_frame  # noqa: E402
from vigil.plans.evaluate import as_of_lit, result_line  # noqa: E402
from vigil.plans.report import summary_text  # noqa: E402
from vigil.plans.runner import run_checks  # noqa: E402
from vigil.session import local_session  # noqa: E402
from vigil.sources import parquet_table  # noqa: E402


def main(base: str) -> None:
    spark = local_session()
    orders = parquet_table(spark, f"{base}/orders.parquet")
    events = parquet_table(spark, f"{base}/events.parquet")
    as_of = "2024-01-31T00:00:00"

    # Pipelines as a config list: unknown keys (here "profile") land in params.
    specs = specs_frame(spark, [
        {"name": "1-URGENT", "check": "row_count", "threshold": 250, "profile": "mysql", "tags": ["orders"]},
        {"name": "5-LOW", "check": "row_count", "threshold": 350, "profile": "mysql", "tags": ["orders"]},
        {"name": "signup", "check": "latest_point", "threshold": 10, "tags": ["events"]},
        {"name": "error", "check": "max_lag_ms", "threshold": 3 * 86400 * 1000, "tags": ["events"]},
        {"name": "refund", "check": "latest_point", "threshold": 1, "tags": ["events"]},   # no data: unknown
    ])

    # One aggregate per (table, key) serves every pipeline of that check.
    measures = [
        M.row_count(orders, "o_orderpriority"),
        M.latest_point(events, "event_type", "ts", "value", tiebreak="event_id"),
        M.max_lag_ms(M.shard_lags(events, "event_type", "user_id", "ts", as_of_lit(as_of))),
    ]
    channels = [{"type": "slack"}, {"type": "sms", "recipients": ["+15559990000"]}]
    run = run_checks(specs, measures, channels, as_of=as_of)

    for row in run.results.select(result_line(run.results).alias("line")).orderBy("line").collect():
        print(row["line"])
    print(run.report.select(summary_text().alias("s")).collect()[0]["s"])
    run.outbox.select("channel", "recipient", "pipeline", "status",
                      F.substring("payload", 1, 60).alias("payload")).show(truncate=False)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
