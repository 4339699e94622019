"""Unit conversion as Column expressions: every quantity has a base unit, and a unit is a factor (or an affine map) to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base units a unit has (metres, seconds, metres a second, joules, one, kilograms, litres).
FACTORS: dict[str, dict[str, float]] = {
    "distance": {"meters": 1.0, "kilometers": 1000.0, "miles": 1609.344, "inches": 0.0254, "feet": 0.3048},
    "time": {"hours": 3600.0, "minutes": 60.0, "seconds": 1.0, "milliseconds": 0.001},
    "speed": {"kph": 1000.0 / 3600.0, "mph": 1609.344 / 3600.0, "mps": 1.0},
    "energy": {"kilowatt_hours": 3.6e6, "gallons_gasoline_equivalent": 1.26832984e8, "gallons_diesel_equivalent": 1.449452e8, "liters_gasoline_equivalent": 3.350554e7, "liters_diesel_equivalent": 3.8290236e7},
    "ratio": {"percent": 0.01, "decimal": 1.0, "millis": 0.001},
    "weight": {"pounds": 0.45359237, "tons": 1000.0, "kilograms": 1.0},
    "volume": {"gallons_us": 3.785411784, "gallons_uk": 4.54609, "liters": 1.0},
}
# Other names of units. Time's are case-sensitive, the rest are not.
ALIASES: dict[str, dict[str, str]] = {
    "distance": {"meter": "meters", "m": "meters", "kilometer": "kilometers", "km": "kilometers", "mile": "miles", "mi": "miles", "inch": "inches", "in": "inches", "foot": "feet", "ft": "feet"},
    "time": {"hour": "hours", "h": "hours", "hr": "hours", "minute": "minutes", "min": "minutes", "second": "seconds", "s": "seconds", "sec": "seconds", "millisecond": "milliseconds", "ms": "milliseconds"},
    "speed": {"kilometers per hour": "kph", "km/h": "kph", "miles per hour": "mph", "mi/h": "mph", "meters per second": "mps", "m/s": "mps"},
    "energy": {"kwh": "kilowatt_hours", "gge": "gallons_gasoline_equivalent", "gallons_gasoline": "gallons_gasoline_equivalent", "gde": "gallons_diesel_equivalent", "gallons_diesel": "gallons_diesel_equivalent", "lge": "liters_gasoline_equivalent", "liters_gasoline": "liters_gasoline_equivalent", "lde": "liters_diesel_equivalent", "liters_diesel": "liters_diesel_equivalent"},
    "ratio": {"%": "percent"},
    "weight": {"pound": "pounds", "lbs": "pounds", "lb": "pounds", "ton": "tons", "kilogram": "kilograms", "kg": "kilograms"},
    "volume": {"gal": "gallons_us", "liter": "liters", "l": "liters"},
    "temperature": {"f": "fahrenheit", "c": "celsius", "k": "kelvin"},
}
# The unit that the state holds for each kind.
DEFAULTS = {"distance": "miles", "time": "minutes", "speed": "mph", "energy": "gallons_gasoline_equivalent", "ratio": "decimal", "temperature": "kelvin"}
# The energy and distance units of an energy rate.
RATES = {
    "gallons_gasoline_per_mile": ("gallons_gasoline_equivalent", "miles"),
    "gallons_diesel_per_mile": ("gallons_diesel_equivalent", "miles"),
    "kilowatt_hours_per_mile": ("kilowatt_hours", "miles"),
    "kilowatt_hours_per_kilometer": ("kilowatt_hours", "kilometers"),
}
TEMPERATURES = ("fahrenheit", "celsius", "kelvin")


def unit_of(kind: str, name: str) -> str:
    """The unit that a name means; an unknown one is an error."""
    key = name.strip() if kind == "time" else name.strip().lower()
    key = ALIASES.get(kind, {}).get(key, key)
    if key not in (TEMPERATURES if kind == "temperature" else FACTORS[kind]):
        raise ValueError(f"unknown {kind} unit '{name}'")
    return key


def kind_of(unit: str) -> str | None:
    """The kind of quantity that a unit's full name belongs to."""
    return next((k for k, units in FACTORS.items() if unit in units), "temperature" if unit in TEMPERATURES else None)


def factor(kind: str, source: str, target: str) -> float:
    source, target = unit_of(kind, source), unit_of(kind, target)
    return FACTORS[kind][source] / FACTORS[kind][target]


def convert(value, kind: str, source: str, target: str):
    """A Column or number in ``target`` units."""
    if kind == "temperature":
        return _temperature(value, unit_of(kind, source), unit_of(kind, target))
    source, target = unit_of(kind, source), unit_of(kind, target)
    return value if source == target else value * factor(kind, source, target)


def _temperature(value, source: str, target: str):
    if source == target:
        return value
    kelvin = {"kelvin": lambda v: v, "celsius": lambda v: v + 273.15, "fahrenheit": lambda v: (v - 32.0) * (5.0 / 9.0) + 273.15}[source](value)
    return {"kelvin": lambda v: v, "celsius": lambda v: v - 273.15, "fahrenheit": lambda v: (v - 273.15) * (9.0 / 5.0) + 32.0}[target](kelvin)


def convert_named(value: Column, kind: str, unit: Column, target: str) -> Column:
    """As ``convert``, for rows that each name their unit; null for an unknown one."""
    name = F.trim(unit) if kind == "time" else F.lower(F.trim(unit))
    if kind == "temperature":
        names = {**{t: t for t in TEMPERATURES}, **ALIASES[kind]}
        return F.coalesce(*[F.when(name == k, _temperature(value, u, target)) for k, u in sorted(names.items())])
    names = {**{u: u for u in FACTORS[kind]}, **ALIASES.get(kind, {})}
    pairs = [x for k, u in sorted(names.items()) for x in (F.lit(k), F.lit(FACTORS[kind][u] / FACTORS[kind][unit_of(kind, target)]))]
    return value * F.try_element_at(F.create_map(*pairs), name)
