"""Plans: specs, evaluation, reports, alert routing, registries."""

from vigil.plans.alerts import alert_text, route_alerts
from vigil.plans.evaluate import as_of_lit, check_all, evaluate, healthy, result_line
from vigil.plans.registry import get_check, get_renderer, register_check, register_renderer
from vigil.plans.report import run_report, summary_text, tag_report
from vigil.plans.runner import Run, run_checks
from vigil.plans.specs import config_frames, normalize_specs, specs_frame, specs_from_json

__all__ = [
    "config_frames", "evaluate", "check_all", "healthy", "result_line", "as_of_lit", "specs_frame", "specs_from_json",
    "normalize_specs", "route_alerts", "alert_text", "run_report", "summary_text", "tag_report",
    "register_check", "get_check", "register_renderer", "get_renderer", "run_checks", "Run",
]
