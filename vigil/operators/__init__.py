"""Measures M1-M33: ``measure(df, key, ...) -> DataFrame[MEASURES]``, all lazy."""

from vigil.operators.base import guarded
from vigil.operators.binding import KEY_SETTING, bind
from vigil.operators.combined import measure_many, newest_row
from vigil.operators.counts import (doc_count, file_count, index_count, keyed_scalar, kv_value, object_count,
                                    paged_count, queue_depth, queue_sketches, sketched_depth, row_count, sql_scalar, text_match_count, view_count)
from vigil.operators.freshness import age_hours, parse_instant, recent_objects
from vigil.operators.lag import (active_tasks, backlog, backlog_until, max_lag_ms, messages_in_window, shard_lags,
                                 total_lag, total_lag_received)
from vigil.operators.probes import json_number_measure, json_truthy_measure, probe_status, state_code
from vigil.operators.runs import latest_attempt, latest_run
from vigil.operators.series import (first_line_with_field, first_value, instant_vector, last_row_value,
                                    latest_point, trailing_range, windowed_stat)
from vigil.operators.static import static_status

__all__ = [
    "row_count", "sql_scalar", "keyed_scalar", "doc_count", "index_count", "text_match_count", "paged_count",
    "view_count", "kv_value", "queue_depth", "queue_sketches", "sketched_depth", "object_count", "file_count", "latest_point", "trailing_range",
    "windowed_stat", "instant_vector", "first_value", "first_line_with_field", "last_row_value", "total_lag",
    "total_lag_received", "max_lag_ms", "shard_lags", "backlog", "backlog_until", "active_tasks",
    "messages_in_window", "recent_objects", "age_hours", "parse_instant", "latest_run", "latest_attempt",
    "json_number_measure", "json_truthy_measure", "state_code", "probe_status", "static_status", "measure_many",
    "newest_row", "guarded", "bind", "KEY_SETTING",
]
