"""Registered queries over /root/testdata: each Spark query next to its DuckDB twin."""

from suite.registry import QUERIES, ORACLES, query  # noqa: F401
from suite import (q_configs, q_counts, q_series, q_lag, q_files, q_runs, q_probes, q_reports, q_alerts,  # noqa: F401,E402
                   q_settings, q_sources, q_stream)
