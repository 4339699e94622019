"""Text of durations and of charging prices, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(milliseconds: Column) -> Column:
    """``h:mm:ss.mmm``, with ``+d.`` before it from one day on."""
    ms = milliseconds.cast("long")
    days, rest = F.floor(ms / 86_400_000), F.pmod(ms, F.lit(86_400_000))
    clock = F.format_string("%d:%02d:%02d.%03d", F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60, rest % 1000)
    return F.when(days > 0, F.concat(F.lit("+"), days.cast("string"), F.lit("."), clock)).otherwise(clock)


# How a price for each kWh is written, in the order in which the forms are tried.
PRICES = [r"(?i)\$(\d+\.?\d*)\s*per\s*kWh", r"(?i)\$(\d+\.?\d*)/kWh", r"(?i)\$(\d+\.?\d*)\s*kWh"]
RANGE = r"(?i)\$(\d+\.?\d*)-\$(\d+\.?\d*)\s*(?:/|per\s*)kWh"


def price_per_kwh(text: Column) -> Column:
    """Dollars for each kWh that a price says; 0 for null, free, and whatever says none.

    The plain forms come first, so a range whose end is written like one of them counts as its end, else as its middle.
    """
    number = lambda pattern, i=1: F.regexp_extract(text, pattern, i).try_cast("double")
    middle = (number(RANGE, 1) + number(RANGE, 2)) / 2
    return F.when(text.isNull() | F.contains(F.lower(text), F.lit("free")), F.lit(0.0)).otherwise(F.coalesce(*map(number, PRICES), middle, F.lit(0.0)))
