"""Numbers: guarded division and fixed-point text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(value: Column) -> Column:
    """A double, NaN as null: both mean that nothing is known."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def ratio_or_blank(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of a double, rounded from its exact binary value.

    Halves that a double holds exactly go to the even neighbour. The fraction is
    taken as a whole number of 2^-52, so the decision is integer arithmetic. From
    2^53 on doubles are whole numbers and are shown as such; NaN and infinity have
    no text.
    """
    scale, unit = 10**digits, 1 << 52
    exact = value.cast("double")
    size = F.when(F.abs(exact) < float(1 << 53), F.abs(exact))
    whole = F.floor(size)
    scaled = ((size - whole) * F.lit(float(unit))).cast("long") * scale
    low = F.shiftright(scaled, 52)
    rest = scaled - low * unit
    up = (rest > unit // 2) | ((rest == unit // 2) & (low % 2 == 1))
    units = low + up.cast("long")
    carried = whole + F.floor((low + up.cast("long")) / scale)
    shown = F.lpad((units % scale).cast("string"), digits, "0")
    whole_text = F.concat(carried.cast("string"), F.lit("."), shown)
    negative = (value < 0) & ((whole > 0) | (units > 0))
    small = F.when(negative, F.concat(F.lit("-"), whole_text)).otherwise(whole_text)
    finite = ~F.isnan(exact) & (F.abs(exact) != float("inf"))
    large = F.format_string(f"%.{digits}f", exact)
    return F.coalesce(small, F.when(finite & (F.abs(exact) >= float(1 << 53)), large))


def percent(value: Column, digits: int) -> Column:
    return F.concat(fixed(value * 100, digits), F.lit("%"))


def change_text(current: Column, baseline: Column) -> Column:
    """Relative change as a percentage text, n/a against a zero baseline."""
    share = F.try_divide((current - baseline).cast("double"), baseline.cast("double"))
    return F.when(baseline == 0, "n/a").otherwise(percent(share, 1))
