from gaugeworks.sources.events import narrow, read_events, read_month_range, stream_events, zero_filled
from gaugeworks.sources.messages import (
    flatten_readings, normalise_alt_messages, parse_alt_messages, parse_messages, rejected_messages, to_messages,
)
from gaugeworks.sources.snapshots import read_ranking, read_snapshot, snapshot_or

__all__ = [
    "flatten_readings", "narrow", "normalise_alt_messages", "parse_alt_messages", "parse_messages", "read_events",
    "read_month_range", "read_ranking", "read_snapshot", "rejected_messages", "snapshot_or", "stream_events",
    "to_messages", "zero_filled",
]
