"""vigil: pipeline health checks as lazy Spark jobs.

measures (one aggregate per source table) -> left join from the specs ->
status by column expressions -> results -> report and alert outbox.
"""

from vigil import functions, operators, plans, sources, streaming
from vigil.plans import check_all, config_frames, evaluate, route_alerts, run_checks, run_report, specs_frame

__all__ = ["functions", "operators", "plans", "sources", "streaming", "evaluate", "check_all", "route_alerts",
           "run_report", "run_checks", "specs_frame", "config_frames"]
