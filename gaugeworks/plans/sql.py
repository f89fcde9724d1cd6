"""Pieces of the checking SQL: the telemetry mapping and the portable arithmetic.

These texts run on another engine over the same tables; of the engine's own modules they use
only the fixed values (names of places, rule tables), so a wrong value there would pass on both sides.
"""

from __future__ import annotations

from gaugeworks.schema import LOCATIONS, RANGE_RULES

_US0 = 1704067200000000


def _mapping(compression: int) -> str:
    sites = ", ".join(f"'{p}'" for p in LOCATIONS)
    name = "CAST(user_id + 1 AS VARCHAR)"
    dec = lambda e: f"CAST({e} AS DECIMAL(12,3))"
    k = "CAST(k AS DECIMAL(8,0))"
    turn = lambda n: f"CAST(event_id % {n} AS DECIMAL(8,0))"
    return f"""
      src AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % 10 AS u FROM events),
      ev AS (SELECT
        make_timestamp({_US0} + CAST(floor((epoch_us(ts) - {_US0}) / {1000 * compression}) AS BIGINT) * 1000) AS timestamp,
        'device-' || lpad({name}, greatest(length({name}), 4)::INTEGER, '0') AS device_id,
        CASE WHEN u < 4 THEN 'temperature-sensor' WHEN u < 7 THEN 'pressure-sensor' ELSE 'multi-sensor' END AS device_type,
        ([{sites}])[user_id % 16 + 1] AS location,
        CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'ERROR' ELSE 'OK' END AS status,
        event_id AS msg_id,
        CASE WHEN u < 4 OR u >= 7 THEN {dec("CAST(value AS DECIMAL(12,2)) * 0.2 + 15")} END AS temperature,
        CASE WHEN u >= 4 THEN {dec(f"1013.25 + ({k} - 50) * 1.4")} END AS pressure,
        CASE WHEN u < 4 OR u >= 7 THEN {dec(f"30 + {k} * 0.68")} END AS humidity,
        {dec(f"3.3 - {turn(90)} * 0.01")} AS voltage,
        CASE WHEN u >= 7 THEN {dec(f"500 + ({k} - 50) * 8")} END AS light_intensity,
        CASE WHEN u >= 7 THEN {dec(f"400 + {turn(200)}")} END AS co2,
        CASE WHEN u >= 7 THEN {dec(f"0.5 + {turn(20)} * 0.1")} END AS vibration,
        CASE WHEN u >= 7 THEN {dec(f"150 + ({k} - 50)")} END AS power_consumption,
        {dec(f"-70 + ({k} - 50) * 0.3")} AS signal_strength,
        {dec(f"100 - {turn(1000)} * 0.1")} AS battery_level
      FROM src),
      lim AS (SELECT max(timestamp) AS t FROM ev)"""


def over_events(body: str, *ctes: str, compression: int = 60) -> str:
    """``body`` over the telemetry frame ``ev`` and its newest time ``lim.t``."""
    return "WITH " + ",".join([_mapping(compression), *ctes]) + "\n" + body


def within(span: str) -> str:
    return f"timestamp >= (SELECT t FROM lim) - INTERVAL '{span}'"


def r(expr: str, digits: int) -> str:
    scale = 10**digits
    return f"floor(CAST({expr} AS DOUBLE) * {scale} + 0.5) / CAST({scale} AS DOUBLE)"


def mean(col: str) -> str:
    return f"CAST(sum({col}) AS DOUBLE) / nullif(count({col}), 0)"


def avg(col: str, digits: int = 2) -> str:
    return r(mean(col), digits)


def low(col: str, digits: int = 2) -> str:
    return r(f"min({col})", digits)


def high(col: str, digits: int = 2) -> str:
    return r(f"max({col})", digits)


def n_status(*statuses: str) -> str:
    return "count(*) FILTER (WHERE status IN (" + ", ".join(f"'{s}'" for s in statuses) + "))"


def pct(part: str, total: str = "count(*)", digits: int = 2) -> str:
    return r(f"(CAST({part} AS DOUBLE) * 100 / nullif({total}, 0))", digits)


def doubles(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)


def latest(keys: str, where: str = "true") -> str:
    """Newest row per key as a subquery."""
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY timestamp DESC, msg_id DESC) AS rn "
        f"FROM ev WHERE {where}) WHERE rn = 1)"
    )


MINUTE = "date_trunc('minute', timestamp)"
HOUR = "date_trunc('hour', timestamp)"


def any_of(rules) -> str:
    """True where one of the rules holds."""
    return "(" + " OR ".join(f"{metric} {sign} {limit:g}" for metric, sign, limit, _ in rules) + ")"


def label(rules, default: str) -> str:
    """Label of the first rule that holds."""
    arms = " ".join(f"WHEN {metric} {sign} {limit:g} THEN '{name}'" for metric, sign, limit, name in rules)
    return f"CASE {arms} ELSE '{default}' END"


# Readings outside their range, the battery left aside.
RANGE5 = any_of(RANGE_RULES[:5])
