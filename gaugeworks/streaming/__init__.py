from gaugeworks.streaming.enrich import publish_dictionary, read_dictionary, sink_enriched
from gaugeworks.streaming.expiring import living, stream_living
from gaugeworks.streaming.flow import count_late, dual_write, late_totals, run_once, sink_rollup, stream_alerts
from gaugeworks.streaming.panes import read_panes, sink_panes
from gaugeworks.streaming.windows import (
    dedup_messages, late_rows, stream_active_devices, stream_counters, stream_event_rate,
    stream_extremes, stream_hot_averages, stream_latest, stream_rollup,
)

__all__ = [
    "count_late", "dedup_messages", "dual_write", "late_rows", "late_totals", "living", "publish_dictionary",
    "read_dictionary", "read_panes", "run_once", "sink_enriched", "sink_panes", "sink_rollup",
    "stream_active_devices", "stream_alerts",
    "stream_counters", "stream_event_rate", "stream_extremes", "stream_hot_averages", "stream_latest",
    "stream_living", "stream_rollup",
]
