from gaugeworks.functions.numbers import (
    mean, percent, readable_quantity, readable_size, rounded, short_count, with_default,
)
from gaugeworks.functions.timing import (
    bucket, day_of, from_epoch_ms, from_iso, instant, interval, month_of, newest, seconds_between, since,
)

__all__ = [
    "bucket", "day_of", "from_epoch_ms", "from_iso", "instant", "interval", "mean", "month_of",
    "newest", "percent", "readable_quantity", "readable_size", "rounded", "seconds_between",
    "short_count", "since", "with_default",
]
