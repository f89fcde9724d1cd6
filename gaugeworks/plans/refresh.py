"""The scheduled refresh of the cached result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gaugeworks.operators import devices as D
from gaugeworks.operators import summaries as A
from gaugeworks.schema import SNAPSHOT_TTL
from gaugeworks.sinks import publish_snapshot

CACHED = {
    "device_stats": A.device_stats,
    "timeseries_1h": A.timeseries,
    "system_health": A.system_health,
    "latest_events": D.latest_events,
    "hourly_stats_24h": A.hourly_stats,
}


def refresh_cache(ev: DataFrame, store: str, as_of) -> None:
    """Run the cached queries and publish each under its key and life time.

    Every query reads only its own trailing span, so the five together cost little more than the
    24-hour one. ``as_of`` is needed: all sets show the same moment, and the bounds are constants.
    """
    for key, build in CACHED.items():
        publish_snapshot(build(ev, as_of=as_of), store, key, SNAPSHOT_TTL[key], as_of)
