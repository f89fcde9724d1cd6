"""Latest reading per device with a life time kept in the state itself.

The state holds one row and one timer per device. A newer reading replaces both; when event time passes the
reading's life time the timer fires, the device leaves the state store and a removal goes out. So the store
is as large as the set of living devices, and who applies the changes in order has no one to filter out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.functions.timing import span_seconds
from gaugeworks.schema import METRICS

# Spark loads the processor in Python processes of its own, also on the driver's side, where this package need not be.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD = T.StructType(
    [T.StructField("at", T.LongType()), T.StructField("msg_id", T.LongType()), T.StructField("status", T.StringType())]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
)
CHANGE = T.StructType([T.StructField("device_id", T.StringType()), *HELD.fields, T.StructField("expired", T.BooleanType())])
_COLUMNS = [f.name for f in HELD.fields]


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["at", "msg_id"], na_position="first").drop_duplicates("device_id", keep="last")


def _newest_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per device and Arrow batch, so that a busy device arrives small."""
    for rows in batches:
        yield _newest(rows)


class Latest(StatefulProcessor):
    """Keeps the newest row of a device until ``life`` microseconds of event time have passed; ``delay`` is the watermark's."""

    def __init__(self, life: int, delay: int):
        self.life, self.delay = life, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("latest", HELD)

    def _expires(self, at: int) -> int:
        """The watermark, in milliseconds, at which a reading is past its life time: event time less the delay."""
        return -((self.delay - at - self.life) // 1000)

    def _change(self, key, row: tuple, expired: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row, expired)], columns=[f.name for f in CHANGE.fields])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.row.get() if self.row.exists() else None
        best = None
        for batch in rows:
            for row in batch[_COLUMNS].itertuples(index=False, name=None):
                row = (int(row[0]), int(row[1]), *[None if pd.isna(v) else v for v in row[2:]])
                if best is None or row[:2] > best[:2]:
                    best = row
        if best is None or (held is not None and tuple(held)[:2] >= best[:2]):
            return
        if self._expires(best[0]) <= timerValues.getCurrentWatermarkInMs():
            return
        if held is not None:
            self.handle.deleteTimer(self._expires(held[0]))
        self.row.update(best)
        self.handle.registerTimer(self._expires(best[0]))
        yield self._change(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.row.exists():
            return
        row = tuple(self.row.get())
        if self._expires(row[0]) > timerValues.getCurrentWatermarkInMs():
            return
        self.row.clear()
        yield self._change(key, row, True)

    def close(self) -> None:
        pass


def stream_living(stream: DataFrame, ttl: str = "15 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Changes of the latest reading per device (update mode): a new one, or ``expired`` when the last one's time is up.

    A reading lives while it is less than ``ttl`` older than the newest event of the stream. Rows without time,
    device or message number are left out. Rows later than the watermark are dropped; of equal times the larger
    message number wins. Spark keeps timers in the RocksDB store only: start the stream in a session of ``session.tuned``,
    or by ``run_once``, which sees to it.
    """
    life, delay = (span_seconds(s) * 1_000_000 for s in (ttl, watermark))
    rows = stream.filter("timestamp IS NOT NULL AND device_id IS NOT NULL AND msg_id IS NOT NULL").select(
        "timestamp", "device_id", F.unix_micros("timestamp").alias("at"), "msg_id", "status",
        *[F.col(m).cast("double").alias(m) for m in METRICS],
    )
    fewer = rows.mapInPandas(_newest_of_batch, rows.schema).withWatermark("timestamp", watermark)
    changes = fewer.groupBy("device_id").transformWithStateInPandas(Latest(life, delay), CHANGE, "Update", "EventTime")
    return changes.select("device_id", F.timestamp_micros("at").alias("timestamp"), *_COLUMNS[1:], "expired")


def living(changes: DataFrame) -> DataFrame:
    """The living devices from their changes, each with the number of its ``batch``: the last change of a device decides."""
    rest = [c for c in changes.columns if c not in ("device_id", "batch")]
    # a removal and a newer reading may fall into one batch, the removal first
    last = F.max_by(F.struct(*rest), F.struct("batch", ~F.col("expired"), "timestamp", "msg_id"))
    return changes.groupBy("device_id").agg(last.alias("r")).filter("NOT r.expired").select("device_id", "r.*").drop("expired")
