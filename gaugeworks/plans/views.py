"""The tables and views under names, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gaugeworks.operators import rollups as R
from gaugeworks.operators.devices import device_status
from gaugeworks.operators.filters import classify_alerts


def register_views(ev: DataFrame, as_of=None, prefix: str = "telemetry_") -> list[str]:
    """Register the events, their two views and the three rollups as temporary views.

    The views are plans, not copies: SQL over them is optimized together with their definition, and a
    filter on time or device reaches the events scan. Where stored rollups exist, register those under
    the same names instead.
    """
    views = {
        "events": ev,
        "device_status": device_status(ev, as_of=as_of),
        "anomalies": classify_alerts(ev, newest_first=False),
        "events_minute": R.rollup(ev, "minute"),
        "events_hour": R.rollup(ev, "hour"),
        "events_day": R.rollup(ev, "day"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
