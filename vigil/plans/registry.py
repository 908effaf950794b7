"""User-registered checks and alert renderers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

_CHECKS: dict[str, Callable] = {}
_RENDERERS: dict[str, Callable[[dict[str, Column]], Column]] = {}


def register_check(name: str, fn: Callable) -> Callable:
    """A measure function ``(df, key, ...) -> DataFrame[MEASURES]`` under a
    case-insensitive name."""
    _CHECKS[name.lower()] = fn
    return fn


def _builtins() -> dict[str, Callable]:
    from vigil import operators as M
    return {
        "row_count": M.row_count, "sql_scalar": M.sql_scalar, "keyed_scalar": M.keyed_scalar,
        "doc_count": M.doc_count, "index_count": M.index_count, "text_match_count": M.text_match_count,
        "paged_count": M.paged_count, "view_count": M.view_count, "kv_value": M.kv_value,
        "queue_depth": M.queue_depth, "object_count": M.object_count, "file_count": M.file_count,
        "latest_point": M.latest_point, "windowed_stat": M.windowed_stat, "instant_vector": M.instant_vector,
        "first_value": M.first_value, "first_line_field": M.first_line_with_field, "last_row_value": M.last_row_value,
        "total_lag": M.total_lag, "total_lag_received": M.total_lag_received, "max_lag_ms": M.max_lag_ms,
        "backlog": M.backlog, "backlog_until": M.backlog_until, "active_tasks": M.active_tasks,
        "messages_in_window": M.messages_in_window, "recent_objects": M.recent_objects, "age_hours": M.age_hours,
        "latest_run": M.latest_run, "latest_attempt": M.latest_attempt, "json_number": M.json_number_measure,
        "json_truthy": M.json_truthy_measure, "state_code": M.state_code, "probe_status": M.probe_status,
        "static_status": M.static_status,
    }


def _all_checks() -> dict[str, Callable]:
    checks = _builtins()
    checks.update(_CHECKS)          # a user registration under a built-in name wins
    return checks


def get_check(name: str) -> Callable:
    """The measure function registered under ``name`` (case-insensitive): user
    checks first, then the built-in measures."""
    checks = _all_checks()
    try:
        return checks[name.lower()]
    except KeyError:
        known = ", ".join(sorted(checks))
        raise KeyError(f"Unknown check '{name}'. Known checks: {known}") from None


def known_checks() -> list[str]:
    return sorted(_all_checks())


def register_renderer(channel_type: str, fn: Callable[[dict[str, Column]], Column]) -> Callable:
    """A payload renderer ``(row columns) -> Column[string]`` for a channel
    type; a later registration replaces an earlier one (built-ins included)."""
    _RENDERERS[channel_type] = fn
    return fn


def get_renderer(channel_type: str) -> Callable[[dict[str, Column]], Column]:
    try:
        return _RENDERERS[channel_type]
    except KeyError:
        known = ", ".join(sorted(_RENDERERS))
        raise KeyError(f"no renderer is registered for channel type {channel_type!r}; there are: {known}") from None


def renderers() -> dict[str, Callable[[dict[str, Column]], Column]]:
    return dict(_RENDERERS)
