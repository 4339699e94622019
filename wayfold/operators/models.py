"""Traversal models: what an edge does to the state of a trip.

A model is written once, against an arithmetic (``Columns`` or ``Numbers``), and so runs both as Spark expressions in the
relational search and number by number in the kernel search. The state has each kind of quantity in its default unit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import functions as F

from wayfold.functions import units
from wayfold.functions.geo import RADIUS_M
from wayfold.functions.interpolate import interpolate, interpolate_point

MILE_M = 1609.344


class ModelError(ValueError):
    """A model that lacks what it needs."""


class Columns:
    """Arithmetic on Spark Columns."""

    where = staticmethod(lambda test, yes, no: F.when(test, yes).otherwise(no))
    least = staticmethod(lambda a, b: F.least(*(x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in (a, b))))
    greatest = staticmethod(lambda a, b: F.greatest(*(x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in (a, b))))
    lit = staticmethod(lambda v: F.lit(v))
    absent = staticmethod(lambda v: v.isNull())
    both = staticmethod(lambda a, b: a & b)
    either = staticmethod(lambda a, b: a | b)
    wrap = staticmethod(lambda v, n: F.pmod(v, F.lit(n)))
    grid = staticmethod(interpolate)

    @staticmethod
    def choose(key, table: dict, default):
        pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default if not isinstance(default, (int, float)) else F.lit(default))

    @staticmethod
    def haversine_miles(x0, y0, x1, y1):
        from wayfold.functions.geo import haversine_m

        return haversine_m(x0, y0, x1, y1) / MILE_M


class Numbers:
    """The same arithmetic on Python numbers; None is null."""

    where = staticmethod(lambda test, yes, no: yes if test else no)
    least = staticmethod(lambda a, b: b if a is None else a if b is None else min(a, b))
    greatest = staticmethod(lambda a, b: b if a is None else a if b is None else max(a, b))
    lit = staticmethod(lambda v: v)
    absent = staticmethod(lambda v: v is None)
    both = staticmethod(lambda a, b: a and b)
    either = staticmethod(lambda a, b: a or b)
    wrap = staticmethod(lambda v, n: v % n)
    grid = staticmethod(interpolate_point)
    choose = staticmethod(lambda key, table, default: table.get(key, default))

    @staticmethod
    def haversine_miles(x0, y0, x1, y1):
        dlat, dlon = math.radians(y1 - y0), math.radians(x1 - x0)
        a = math.sin(dlat / 2) ** 2 + math.cos(math.radians(y0)) * math.cos(math.radians(y1)) * math.sin(dlon / 2) ** 2
        return 2 * RADIUS_M * math.asin(math.sqrt(min(a, 1.0))) / MILE_M


@dataclass(frozen=True)
class Feature:
    """A state variable. An accumulator carries over from edge to edge; others start from ``initial`` on each."""

    name: str
    kind: str  # distance, time, speed, energy, ratio, temperature, custom
    accumulator: bool = False
    initial: float = 0.0
    output_unit: str | None = None
    least: bool = False  # an accumulator that keeps its least value instead of a sum


class TraversalModel:
    """``traverse`` returns the new values of ``outputs``. ``edge`` has the edge's columns, ``state`` the values so far, ``q``
    the request's parameters. ``history`` is true if the result depends on more than the edge and state that adds up;
    ``by_edge`` then says that the edge before is all that it depends on."""

    inputs: list[str] = []
    outputs: list[Feature] = []
    history = by_edge = False

    def traverse(self, o, edge: dict, state: dict, q: dict) -> dict:
        raise NotImplementedError

    def estimate(self, o, pair: dict, state: dict, q: dict) -> dict:
        """The same for the straight way between two vertices, never more than any path's."""
        return {}


@dataclass
class Distance(TraversalModel):
    include_trip: bool = True

    def __post_init__(self):
        self.outputs = [Feature("edge_distance", "distance"), *([Feature("trip_distance", "distance", True)] if self.include_trip else [])]

    def traverse(self, o, edge, state, q):
        return self._add(edge["distance_m"] / MILE_M, state)

    def estimate(self, o, pair, state, q):
        return self._add(o.haversine_miles(pair["src_x"], pair["src_y"], pair["dst_x"], pair["dst_y"]), state)

    def _add(self, miles, state):
        return {"edge_distance": miles} | ({"trip_distance": state["trip_distance"] + miles} if self.include_trip else {})


@dataclass
class Speed(TraversalModel):
    """Table lookup, at most the request's speed limit. ``fastest`` (mph) is the table's maximum, for estimates."""

    column: str = "speed_kph"
    unit: str = "kph"
    fastest: float | None = None

    def __post_init__(self):
        self.outputs = [Feature("edge_speed", "speed")]

    def _limited(self, o, mph, q):
        limit, name = q.get("speed_limit"), q.get("speed_limit_unit")
        if limit is None:
            return mph
        if name is None:
            raise ModelError("a speed limit needs a unit")
        return o.least(mph, units.convert(limit, "speed", name, "mph"))

    def traverse(self, o, edge, state, q):
        return {"edge_speed": self._limited(o, units.convert(edge[self.column], "speed", self.unit, "mph"), q)}

    def estimate(self, o, pair, state, q):
        if self.fastest is None or self.fastest <= 0:
            raise ModelError("the speed table's maximum is not known or not above zero")
        return {"edge_speed": self._limited(o, o.lit(self.fastest), q)}


def fastest_mph(edges, column: str = "speed_kph", unit: str = "kph") -> float:
    """The table's greatest speed; an empty table and one of zeros are errors."""
    r = edges.agg(F.max(column).alias("most"), F.count(column).alias("n")).first()
    if not r["n"] or not r["most"] or r["most"] <= 0:
        raise ModelError("the speed table is empty or has no speed above zero")
    return units.convert(float(r["most"]), "speed", unit, "mph")


@dataclass
class Time(TraversalModel):
    """Minutes from distance and speed. A way without speed takes for ever, and so is never taken."""

    include_trip: bool = True
    inputs: list = field(default_factory=lambda: ["edge_distance", "edge_speed"])

    def __post_init__(self):
        self.outputs = [Feature("edge_time", "time"), *([Feature("trip_time", "time", True)] if self.include_trip else [])]

    def traverse(self, o, edge, state, q):
        d, v = state["edge_distance"], state["edge_speed"]
        minutes = o.where(d == 0, o.lit(0.0), o.where(v > 0, d / o.where(v > 0, v, o.lit(1.0)) * 60.0, o.lit(math.inf)))
        return {"edge_time": minutes} | ({"trip_time": state["trip_time"] + minutes} if self.include_trip else {})

    def estimate(self, o, pair, state, q):
        return self.traverse(o, pair, state, q)


@dataclass
class Grade(TraversalModel):
    column: str = "grade"
    unit: str = "decimal"

    def __post_init__(self):
        self.outputs = [Feature("edge_grade", "ratio")]

    def traverse(self, o, edge, state, q):
        return {"edge_grade": units.convert(edge[self.column], "ratio", self.unit, "decimal")}


@dataclass
class Elevation(TraversalModel):
    """Climb and descent; the descent stays negative. In miles, as all distances of the state."""

    inputs: list = field(default_factory=lambda: ["edge_distance", "edge_grade"])

    def __post_init__(self):
        self.outputs = [Feature("trip_elevation_gain", "distance", True), Feature("trip_elevation_loss", "distance", True)]

    def traverse(self, o, edge, state, q):
        change = state["edge_distance"] * state["edge_grade"]
        return {
            "trip_elevation_gain": state["trip_elevation_gain"] + o.where(change > 0, change, o.lit(0.0)),
            "trip_elevation_loss": state["trip_elevation_loss"] + o.where(change < 0, change, o.lit(0.0)),
        }


@dataclass
class Temperature(TraversalModel):
    """A constant from the request (``ambient_temperature``, ``ambient_temperature_unit``) or the default in °F."""

    default_f: float | None = None

    def __post_init__(self):
        self.outputs = [Feature("ambient_temperature", "temperature", output_unit="fahrenheit")]

    def traverse(self, o, edge, state, q):
        value = q.get("ambient_temperature")
        if value is None and self.default_f is None:
            raise ModelError("no ambient temperature in the request and no default")
        unit = q.get("ambient_temperature_unit") or "fahrenheit"
        return {"ambient_temperature": o.lit(units.convert(self.default_f, "temperature", "fahrenheit", "kelvin")) if value is None else units.convert(value, "temperature", unit, "kelvin")}

    def estimate(self, o, pair, state, q):
        return self.traverse(o, pair, state, q)


def bearing_change(o, departure, arrival):
    """Degrees from one heading to the next, in [-180, 180]."""
    angle = arrival - departure
    return o.where(angle > 180, angle - 360, o.where(angle < -180, angle + 360, angle))


# The greatest whole degrees to the left and right of each turn.
TURNS = [("no_turn", 19), ("slight", 44), ("turn", 134), ("sharp", 159), ("u_turn", 180)]


def turn_class(o, angle):
    """One of no_turn, slight_left, slight_right, left, right, sharp_left, sharp_right, u_turn."""
    size = o.where(angle < 0, -angle, angle)
    sided = lambda left, right: o.where(angle < 0, o.lit(left), o.lit(right))
    return o.where(size <= 19, o.lit("no_turn"), o.where(size <= 44, sided("slight_left", "slight_right"), o.where(size <= 134, sided("left", "right"), o.where(size <= 159, sided("sharp_left", "sharp_right"), o.lit("u_turn")))))


@dataclass
class TurnDelay(TraversalModel):
    """Seconds for each class of turn from the edge before, added to the delay and to the edge's and trip's time."""

    seconds: dict[str, float] = field(default_factory=dict)
    inputs: list = field(default_factory=lambda: ["edge_time", "trip_time"])
    history = by_edge = True

    def __post_init__(self):
        missing = {"no_turn", "slight_left", "slight_right", "left", "right", "sharp_left", "sharp_right", "u_turn"} - set(self.seconds)
        if missing:
            raise ModelError(f"no delay for turns {sorted(missing)}")
        self.outputs = [Feature("edge_turn_delay", "time"), Feature("edge_time", "time"), Feature("trip_time", "time", True)]

    def traverse(self, o, edge, state, q):
        before = edge["prev_departure_heading"]
        none = o.absent(before)
        angle = bearing_change(o, o.where(none, o.lit(0), before), edge["arrival_heading"])
        minutes = o.where(none, o.lit(0.0), o.choose(turn_class(o, angle), self.seconds, 0.0) / 60.0)
        return {"edge_turn_delay": minutes, "edge_time": state["edge_time"] + minutes, "trip_time": state["trip_time"] + minutes}


@dataclass
class Custom(TraversalModel):
    """A table's value: as it is, or accumulated (a sum; for booleans, true while all are)."""

    name: str = "custom"
    column: str = "custom"
    boolean: bool = False
    accumulator: bool = False
    initial: float = 0.0

    def __post_init__(self):
        self.outputs = [Feature(self.name, "custom", self.accumulator, self.initial, least=self.boolean)]

    def traverse(self, o, edge, state, q):
        value = edge[self.column]
        if self.boolean:
            value = o.where(value, o.lit(1.0), o.lit(0.0))
        if not self.accumulator:
            return {self.name: value}
        return {self.name: o.least(state[self.name], value) if self.boolean else state[self.name] + value}


def ordered(models: list[TraversalModel]) -> list[TraversalModel]:
    """Producers before consumers; a missing input or a circle is an error. What a model makes itself it need not be given."""
    made = {f.name for m in models for f in m.outputs}
    for m in models:
        if missing := [x for x in m.inputs if x not in made]:
            raise ModelError(f"{type(m).__name__} needs {missing}, which no model makes")
    out, left, ready = [], list(models), set()
    while left:
        for m in left:
            own = {f.name for f in m.outputs}
            others = {f.name for x in left if x is not m for f in x.outputs} - own
            if all(x in own or x in ready or x not in others for x in m.inputs) and not any(x in own and any(x in {f.name for f in y.outputs} and x not in y.inputs for y in left if y is not m) for x in m.inputs):
                out.append(m)
                ready |= own
                left.remove(m)
                break
        else:
            raise ModelError(f"models need each other in a circle: {[type(m).__name__ for m in left]}")
    return out


def features_of(models: list[TraversalModel], overrides: dict[str, float] | None = None) -> list[Feature]:
    """The state's features by name; of two with one name, the first with an output unit, else the first. ``overrides`` sets
    initial values; an unknown name is an error."""
    found: dict[str, Feature] = {}
    for m in models:
        for f in m.outputs:
            if f.name not in found or (found[f.name].output_unit is None and f.output_unit is not None):
                found[f.name] = f
    for name, value in (overrides or {}).items():
        if name not in found:
            raise ModelError(f"unknown state feature '{name}'")
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ModelError(f"state feature '{name}' needs a number")
        f = found[name]
        found[name] = replace(f, initial=float(value))
    return [found[k] for k in sorted(found)]


def step(o, models: list[TraversalModel], features: list[Feature], edge: dict, before: dict[str, Any], q: dict, estimate: bool = False) -> dict[str, Any]:
    """The state after an edge: accumulators carried over, others from their start, then each model in order."""
    state = {f.name: before[f.name] if f.accumulator else o.lit(f.initial) for f in features}
    for m in models:
        state |= m.estimate(o, edge, state, q) if estimate else m.traverse(o, edge, state, q)
    return state
