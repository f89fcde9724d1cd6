from gaugeworks.sinks.live import drop_old_state, latest_state, sink_batched, upsert_latest
from gaugeworks.sinks.moves import all_rows, move_expired
from gaugeworks.sinks.replay import live_stats_of, read_replay, replay_length, sink_replay
from gaugeworks.sinks.segments import read_segments, write_segment
from gaugeworks.sinks.tables import archive_expired, publish_snapshot, settle_months, write_events, write_indexed

__all__ = [
    "all_rows", "archive_expired", "drop_old_state", "latest_state", "live_stats_of", "move_expired", "publish_snapshot",
    "read_replay", "read_segments", "replay_length", "settle_months", "sink_batched", "sink_replay",
    "upsert_latest", "write_events", "write_indexed", "write_segment",
]
