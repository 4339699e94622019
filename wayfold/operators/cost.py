"""Cost: weights and rates over the features of the state.

On each edge a feature costs its rate times what it grew by (accumulators) or is (others), plus what the network asks for the
edge or its first vertex, and at least ``LEAST``. The sum is the total cost; the weighted sum is what a search minimises.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import units
from wayfold.operators.models import Feature

LEAST = 1e-10


class CostError(ValueError):
    """Weights or rates that make no cost."""


@dataclass(frozen=True)
class Rate:
    """zero, raw, or a factor for each unit of a quantity (distance, time, speed, energy, ratio, temperature, custom)."""

    kind: str = "raw"
    factor: float = 1.0
    unit: str | None = None

    @classmethod
    def of(cls, spec: dict | str) -> Rate:
        spec = {"type": spec} if isinstance(spec, str) else spec
        kind = spec["type"]
        if kind not in ("zero", "raw", "distance", "time", "speed", "energy", "ratio", "temperature", "custom"):
            raise CostError(f"unknown rate type '{kind}'")
        return cls(kind, float(spec.get("factor", 1.0) if spec.get("factor") is not None else 1.0), spec.get("unit"))

    def value(self, value, feature: Feature):
        """The cost of a value that is in the feature's default unit."""
        if self.kind == "zero":
            return value * 0.0
        if self.kind in ("raw", "custom"):
            return value * self.factor
        if feature.kind not in (self.kind, "custom"):
            raise CostError(f"a {self.kind} rate does not fit feature '{feature.name}' ({feature.kind})")
        return units.convert(value, self.kind, units.DEFAULTS[self.kind], self.unit or units.DEFAULTS[self.kind]) * self.factor


@dataclass
class CostModel:
    """``network`` maps a feature to the edge columns whose values are added to its cost (absent ones count 0).

    ``own_weights``: each request has weights of its own, in a column ``weights`` (map of feature to weight); the weights here
    then only name the features that there may be.
    """

    weights: dict[str, float]
    rates: dict[str, Rate]
    network: dict[str, list[str]] = field(default_factory=dict)
    ignore_unknown: bool = False
    own_weights: bool = False

    def for_requests(self, features: list[Feature]) -> CostModel:
        """The model for requests with weights of their own: every feature with a rate or a network cost may be weighted."""
        names = [f.name for f in features if f.name in self.rates or f.name in self.network]
        return CostModel(dict.fromkeys(names, 1.0), self.rates, self.network, self.ignore_unknown, True)

    def weights_error(self, weights: Column, features: list[Feature]) -> Column:
        """What is wrong with a request's weights (a map column), or null."""
        known = F.array(*[F.lit(f.name) for f in features])
        unknown = F.lit(None).cast("string") if self.ignore_unknown else F.when(F.size(F.array_except(F.map_keys(weights), known)) > 0, F.concat(F.lit("weights for unknown features "), F.array_join(F.array_sort(F.array_except(F.map_keys(weights), known)), ", ")))
        negative = F.when(F.exists(F.map_values(weights), lambda w: w < 0), F.lit("a weight is negative"))
        free = [k for k in [*self.rates, *self.network] if k in self.network or (self.rates[k].kind != "zero" and self.rates[k].factor)]
        usable = F.exists(F.map_entries(weights), lambda e: e["key"].isin(free) & (e["value"] > 0)) if free else F.lit(False)
        return F.coalesce(unknown, negative, F.when(~usable, F.lit("all costs are zero: give a weight and a rate to some feature")))

    def checked(self, features: list[Feature]) -> CostModel:
        """Weights that fit the features; unknown ones are an error or ignored, features without a rate are left out."""
        known = {f.name for f in features}
        unknown = sorted(set(self.weights) - known)
        if unknown and not self.ignore_unknown:
            raise CostError(f"weights for unknown features {unknown}")
        if any(w < 0 for w in self.weights.values()):
            raise CostError("a weight is negative")
        used = {k: w for k, w in self.weights.items() if k in known and (k in self.rates or k in self.network)}
        if not any(w * (self.rates.get(k, Rate()).factor if self.rates.get(k, Rate()).kind != "zero" or k in self.network else 0) for k, w in used.items()):
            raise CostError("all costs are zero: give a weight and a rate to some feature")
        return CostModel(used, {k: self.rates.get(k, Rate("zero")) for k in used}, self.network, self.ignore_unknown, self.own_weights)

    def merged(self, weights: dict | None, rates: dict | None) -> CostModel:
        """A request's weights and rates before the configured ones, key by key."""
        return CostModel(self.weights | (weights or {}), self.rates | {k: Rate.of(v) for k, v in (rates or {}).items()}, self.network, self.ignore_unknown, self.own_weights)

    def parts(self, o, features: list[Feature], before: dict[str, Any], after: dict[str, Any], edge: dict | None) -> dict[str, Any]:
        """The unweighted cost of each feature. The network's charge on an accumulator is there before and after, and so
        takes itself away."""
        made = {}
        for f in features:
            if f.name in self.weights:
                rate = self.rates[f.name]
                cost = rate.value(after[f.name], f)
                if f.accumulator:
                    cost = cost - rate.value(before[f.name], f)
                elif edge is not None:
                    for column in self.network.get(f.name, []):
                        cost = cost + o.where(o.absent(edge[column]), o.lit(0.0), edge[column])
                made[f.name] = o.greatest(cost, LEAST)
        return made

    def costs(self, o, features: list[Feature], before: dict, after: dict, edge: dict | None = None) -> tuple[Any, Any]:
        """(objective, total)."""
        objective = total = None
        for name, cost in self.parts(o, features, before, after, edge).items():
            weight = self.weights[name]
            if self.own_weights:  # a feature that a request does not weigh costs it nothing
                weight = F.try_element_at(F.col("weights"), F.lit(name))
                weight, cost = F.coalesce(weight, F.lit(0.0)), F.when(weight.isNull(), F.lit(0.0)).otherwise(cost)
            objective = cost * weight if objective is None else objective + cost * weight
            total = cost if total is None else total + cost
        return objective, total

    def description(self) -> list[dict]:
        return [{"feature": k, "index": i, "weight": self.weights[k], "rate": self.rates[k].kind, "factor": self.rates[k].factor, "unit": self.rates[k].unit, "network": self.network.get(k, [])} for i, k in enumerate(sorted(self.weights))]


def aggregate(costs: Column, how: str = "sum") -> Column:
    """Sum or product of an array of costs; both are 0 for an empty one."""
    if how == "sum":
        return F.aggregate(costs, F.lit(0.0), lambda a, x: a + x)
    if how == "mul":
        return F.when(F.size(costs) == 0, F.lit(0.0)).otherwise(F.aggregate(costs, F.lit(1.0), lambda a, x: a * x))
    raise CostError(f"unknown aggregation '{how}'")


def with_network_costs(edges: DataFrame, edge_costs: DataFrame | None = None, vertex_costs: DataFrame | None = None, name: str = "network_cost") -> DataFrame:
    """Adds what the network asks for an edge (edge_id, cost) and for its first vertex (vertex_id, cost); absent ones are 0."""
    out, found = edges, []
    if edge_costs is not None:
        out = out.join(edge_costs.select("edge_id", F.col("cost").alias("__edge")), "edge_id", "left")
        found.append("__edge")
    if vertex_costs is not None:
        out = out.join(vertex_costs.select(F.col("vertex_id").alias("src"), F.col("cost").alias("__vertex")), "src", "left")
        found.append("__vertex")
    total = F.lit(0.0)
    for c in found:
        total = total + F.coalesce(c, F.lit(0.0))
    return out.withColumn(name, total).drop(*found)
