"""Which edges a trip may use.

Constraints that need only the edge are applied once, before a search; those that need the trip's state or the edge before
it, on each step. ``prefilter`` does the former, ``allows`` the latter (against either arithmetic).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import units
from wayfold.operators.graph import KEY
from wayfold.plans.scratch import spread


class ConstraintError(ValueError):
    """A constraint that lacks what it needs."""


class Constraint:
    """``history`` is true if ``allows`` looks at the edge before or at the state; ``by_edge`` then says that the edge before is
    all that it looks at."""

    history = by_edge = False

    def prefilter(self, edges: DataFrame) -> DataFrame:
        return edges

    def allows(self, o, edge: dict, state: dict):
        """A test of a step, or None if there is nothing to test."""
        return None


class NoRestriction(Constraint):
    pass


@dataclass
class RoadClass(Constraint):
    """Edges of the allowed classes; all of them without a list. A class that the network lacks is an error."""

    allowed: list | None = None
    column: str = "road_class"

    def prefilter(self, edges):
        if self.allowed is None:
            return edges
        names = [str(a).lower() if isinstance(a, bool) else str(a) for a in self.allowed]
        known = [str(r[0]) for r in edges.select(self.column).distinct().limit(257).collect()]
        if len(known) > 256:
            raise ConstraintError("more than 256 road classes")
        if unknown := sorted(set(names) - set(known)):
            raise ConstraintError(f"unknown road classes {unknown}")
        return edges.filter(F.col(self.column).cast("string").isin(names))


# The restrictions on vehicles, their quantity, and the unit that they are compared in.
VEHICLE = {"maximum_height": "distance", "maximum_width": "distance", "maximum_total_length": "distance", "maximum_trailer_length": "distance", "maximum_total_weight": "weight", "maximum_weight_per_axle": "weight"}
VEHICLE_ALIASES = {"height": "maximum_height", "width": "maximum_width", "total_length": "maximum_total_length", "trailer_length": "maximum_trailer_length", "total_weight": "maximum_total_weight", "weight_per_axle": "maximum_weight_per_axle"}
BASE_UNIT = {"distance": "meters", "weight": "kilograms"}


def parameter_name(name: str) -> str:
    key = name.strip().lower()
    key = VEHICLE_ALIASES.get(key, key)
    if key not in VEHICLE:
        raise ConstraintError(f"unknown vehicle parameter '{name}'")
    return key


def compare(left: Column, operation: Column, right: Column) -> Column:
    """``left operation right`` for an operation in a column; null for an unknown one."""
    return F.when(operation == "<", left < right).when(operation == ">", left > right).when(operation == "=", left == right).when(operation == "<=", left <= right).when(operation == ">=", left >= right)


def normalised_restrictions(rows: DataFrame, order: str | None = None) -> DataFrame:
    """(edge_id, name, operation, limit) in metres and kilograms from (edge_id, name, value, operation, unit).

    One for each edge and parameter; of several the last counts, by ``order`` or by value and operation.
    """
    name = F.lower(F.trim("name"))
    canonical = F.coalesce(*[F.when(name.isin(k, v), v) for k, v in VEHICLE_ALIASES.items()])
    kind = F.coalesce(*[F.when(canonical == k, v) for k, v in VEHICLE.items()])
    limit = F.when(kind == "distance", units.convert_named(F.col("value"), "distance", F.col("unit"), "meters")).otherwise(units.convert_named(F.col("value"), "weight", F.col("unit"), "kilograms"))
    made = rows.select("edge_id", canonical.alias("name"), F.trim("operation").alias("operation"), limit.alias("limit"), F.col(order).alias("at") if order else F.struct("value", "operation").alias("at"))
    return spread(made, "edge_id", tag="restrictions").groupBy("edge_id", "name").agg(F.max_by(F.struct("operation", "limit"), "at").alias("r")).select("edge_id", "name", "r.operation", "r.limit")


@dataclass
class VehicleRestriction(Constraint):
    """Edges whose restrictions the vehicle meets. ``parameters``: (name, value, unit); None is an error, none allows all."""

    restrictions: DataFrame = None
    parameters: list[tuple[str, float, str]] | None = None

    def prefilter(self, edges):
        if self.parameters is None:
            raise ConstraintError("the request has no vehicle_parameters")
        if not self.parameters:
            return edges
        tests = F.lit(False)
        for name, value, unit in self.parameters:
            key = parameter_name(name)
            mine = units.convert(float(value), VEHICLE[key], unit, BASE_UNIT[VEHICLE[key]])
            tests = tests | ((F.col("name") == key) & ~compare(F.lit(mine), F.col("operation"), F.col("limit")))
        return edges.join(self.restrictions.filter(tests).select("edge_id").distinct(), "edge_id", "left_anti")


@dataclass
class TurnRestriction(Constraint):
    """Forbidden pairs of edges (prev_edge_id, next_edge_id); a trip's first edge is always allowed."""

    pairs: DataFrame = None
    history = by_edge = True

    def kernel_pairs(self, most: int = 5_000_000) -> set[tuple[int, int]]:
        """The pairs for a kernel's memory; too many are an error."""
        rows = self.pairs.select("prev_edge_id", "next_edge_id").limit(most + 1).collect()
        if len(rows) > most:
            raise ConstraintError(f"more than {most} turn restrictions: use the relational search")
        return {(r[0], r[1]) for r in rows}


@dataclass
class Battery(Constraint):
    """Only while the charge is above the bound; trips without a charge are free."""

    lower: float = 0.0
    history = True

    def allows(self, o, edge, state):
        return state["trip_soc"] > self.lower if "trip_soc" in state else None


@dataclass
class Combined(Constraint):
    parts: list[Constraint] = field(default_factory=list)

    def __post_init__(self):
        self.history = any(p.history for p in self.parts)

    def prefilter(self, edges):
        for p in self.parts:
            edges = p.prefilter(edges)
        return edges

    def allows(self, o, edge, state):
        tests = [t for p in self.parts if (t := p.allows(o, edge, state)) is not None]
        made = None
        for t in tests:
            made = t if made is None else o.both(made, t)
        return made


@dataclass
class EdgeCut(Constraint):
    """Hides edges from everyone: rows of (edge_list_id, edge_id)."""

    cut: DataFrame = None

    def prefilter(self, edges):
        return edges.join(self.cut.select(*KEY), KEY, "left_anti")


def stations_of_types(stations: DataFrame, power_types: list[str]) -> DataFrame:
    return stations.filter(F.lower("power_type").isin([p.lower() for p in power_types]))
