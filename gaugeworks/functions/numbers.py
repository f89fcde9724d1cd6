"""Number expressions: means, percentages, rounding, readable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mean(c: Column | str) -> Column:
    """Mean of the present values as a double; NULL when there are none.

    Sum and count merge map-side, and a decimal sum is exact whatever the order of the rows.
    """
    c = _col(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def rounded(c: Column | str, digits: int) -> Column:
    """Round half up on the double value itself, the same in every engine."""
    scale = float(10**digits)
    return F.floor(_col(c).cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """``part`` of ``total`` in percent; NULL when there is nothing to divide by."""
    return rounded(F.try_divide(part * F.lit(100.0), total), digits)


def with_default(c: Column | str, default) -> Column:
    return F.coalesce(_col(c), F.lit(default))


def _scaled_text(c: Column, steps: list[tuple[float, str]], digits: int, smallest: Column) -> Column:
    """Text of ``c`` in the largest unit that fits; ``steps`` lists (size, unit), largest first."""
    out = None
    for size, unit in steps:
        text = F.format_string(f"%.{digits}f{unit}", rounded(c.cast("double") / F.lit(size), digits))
        out = F.when(c >= F.lit(size), text) if out is None else out.when(c >= F.lit(size), text)
    return out.otherwise(smallest)


def readable_size(c: Column | str) -> Column:
    """Bytes with binary units and two decimals, e.g. ``1.50 MiB``."""
    c = _col(c)
    names = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
    steps = [(float(1024 ** (i + 1)), f" {u}") for i, u in enumerate(names)][::-1]
    return _scaled_text(c, steps, 2, F.format_string("%.2f B", c.cast("double")))


def readable_quantity(c: Column | str) -> Column:
    """Counts in words with two decimals, e.g. ``12.30 thousand``."""
    c = _col(c)
    names = ("thousand", "million", "billion", "trillion", "quadrillion")
    steps = [(float(1000 ** (i + 1)), f" {u}") for i, u in enumerate(names)][::-1]
    return _scaled_text(c, steps, 2, F.format_string("%.2f", c.cast("double")))


def short_count(c: Column | str) -> Column:
    """Axis labels: ``1.2M``, ``3.4K`` or the plain number."""
    c = _col(c)
    return _scaled_text(c, [(1e6, "M"), (1e3, "K")], 1, c.cast("string"))
