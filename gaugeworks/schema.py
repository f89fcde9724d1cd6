"""Shapes and fixed value tables of the telemetry domain."""

from __future__ import annotations

from pyspark.sql import types as T

# The ten measured quantities, in table order.
METRICS = (
    "temperature",
    "pressure",
    "humidity",
    "voltage",
    "light_intensity",
    "co2",
    "vibration",
    "power_consumption",
    "signal_strength",
    "battery_level",
)

# Which quantities each device type reports.
DEVICE_METRICS = {
    "temperature-sensor": ("temperature", "humidity", "voltage", "battery_level", "signal_strength"),
    "pressure-sensor": ("pressure", "voltage", "battery_level", "signal_strength"),
    "multi-sensor": METRICS,
}

# The sixteen sites a device can stand at.
LOCATIONS = (
    "floor-1-north", "floor-1-south", "floor-1-east", "floor-1-west",
    "floor-2-north", "floor-2-south", "floor-2-east", "floor-2-west",
    "basement", "rooftop", "warehouse-a", "warehouse-b",
    "outdoor-north", "outdoor-south", "server-room", "lobby",
)

# Fixed values: (metric, unit, warn, critical, direction). "low" means that small values are bad.
THRESHOLDS = (
    ("temperature", "celsius", 35.0, 40.0, "high"),
    ("pressure", "hPa", 1050.0, 1070.0, "high"),
    ("humidity", "percent", 85.0, 95.0, "high"),
    ("voltage", "volts", 2.8, 2.5, "low"),
    ("battery_level", "percent", 20.0, 10.0, "low"),
)

# First match wins, for rows that already carry a WARN or CRITICAL status.
ALERT_RULES = (
    ("temperature", ">", 40.0, "temperature_critical"),
    ("temperature", ">", 35.0, "temperature_warn"),
    ("pressure", ">", 1070.0, "pressure_critical"),
    ("pressure", ">", 1050.0, "pressure_warn"),
    ("battery_level", "<", 10.0, "battery_critical"),
    ("battery_level", "<", 20.0, "battery_warn"),
)

# First match wins, for readings outside their normal range.
RANGE_RULES = (
    ("temperature", ">", 80.0, "High Temp"),
    ("temperature", "<", 10.0, "Low Temp"),
    ("pressure", ">", 1050.0, "High Pressure"),
    ("pressure", "<", 950.0, "Low Pressure"),
    ("humidity", ">", 95.0, "High Humidity"),
    ("battery_level", "<", 20.0, "Low Battery"),
)

# Colour steps of the dashboard panels, as (from value, label), lowest first.
FRESHNESS_BANDS = ((None, "green"), (60, "yellow"), (300, "red"))
LAST_EVENT_BANDS = ((None, "green"), (30, "yellow"), (60, "red"))
BATTERY_BANDS = ((None, "red"), (20, "yellow"), (50, "green"))
WARNING_BANDS = ((None, "green"), (5, "yellow"), (10, "red"))

# How long each table keeps its rows.
RETENTION = {"events": "90 days", "minute": "7 days", "hour": "365 days", "day": "2 years"}

# Life time of each cached result set, in seconds.
SNAPSHOT_TTL = {
    "device_stats": 120,
    "timeseries_1h": 120,
    "system_health": 120,
    "latest_events": 60,
    "hourly_stats_24h": 300,
}

HEADER = ("timestamp", "device_id", "device_type", "location", "status", "msg_id")
NARROW = ("timestamp", "device_id", "temperature", "pressure", "status", "msg_id")

EVENTS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("msg_id", T.LongType()),
    ]
    + [T.StructField(m, T.FloatType()) for m in METRICS]
)

# JSON text of one flat reading; the time is an ISO-8601 string.
MESSAGE = T.StructType(
    [T.StructField("timestamp", T.StringType())]
    + [f for f in EVENTS.fields if f.name in HEADER[1:5]]
    + [T.StructField("msg_id", T.LongType())]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
)

# JSON text of the load-test clients: camel-case id, epoch milliseconds, three quantities.
ALT_MESSAGE = T.StructType(
    [
        T.StructField("deviceId", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("pressure", T.DoubleType()),
        T.StructField("padding", T.StringType()),
    ]
)

# Presence notices published when a device connects or drops off.
PRESENCE = T.StructType(
    [
        T.StructField("online", T.BooleanType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
