"""Structured Streaming checks R1-R3 and the file stream source S9."""

from vigil.streaming.state_log import StateLog
from vigil.streaming.windows import (alert_batches, evaluate_batches, event_time, file_stream, kafka_stream, late_event_measures,
                                     late_events, newest_per_key, partition_progress, run_available, watermark_of,
                                     window_count_measures, window_counts)

__all__ = ["StateLog", "alert_batches", "file_stream", "kafka_stream", "event_time", "window_counts", "partition_progress", "newest_per_key",
           "evaluate_batches", "run_available", "window_count_measures", "late_events", "late_event_measures", "watermark_of"]
