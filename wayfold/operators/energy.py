"""Energy: prediction from grids, vehicles with engines and batteries, charging.

Energy in the state is in gasoline-gallon equivalents, like all energy there; battery figures are given in kWh.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

from wayfold.functions import units
from wayfold.functions.interpolate import linspace
from wayfold.operators.models import Feature, ModelError, TraversalModel
from wayfold.plans.scratch import spread

KWH = units.factor("energy", "kilowatt_hours", "gallons_gasoline_equivalent")


@dataclass
class Prediction:
    """An energy rate over a grid of input features, in the units that the vehicle's file declares.

    ``inputs`` has (state feature, kind, unit) for each axis; ``axes`` (low, high, bins); ``values`` the rates, last axis
    fastest.
    """

    inputs: list[tuple[str, str, str]]
    axes: list[tuple[float, float, int]]
    values: list[float]
    rate_unit: str
    real_world: float = 1.0
    best_rate: float | None = None

    def __post_init__(self):
        if self.rate_unit not in units.RATES:
            raise ModelError(f"unknown energy rate unit '{self.rate_unit}'")
        if self.best_rate is None:
            self.best_rate = max(0.0, min(self.values)) * self.real_world

    @classmethod
    def of_function(cls, f, inputs, axes, rate_unit, real_world=1.0) -> Prediction:
        """Samples a function over the grid: how a regressor is replaced by a table."""
        return cls(inputs, axes, [float(f(*x)) for x in itertools.product(*(linspace(*a) for a in axes))], rate_unit, real_world)

    @classmethod
    def of_forest(cls, forest, inputs, axes, rate_unit, real_world=1.0) -> Prediction:
        """The grid of a fitted forest (see ``fitted_forest``), whose features are the inputs in their units, in order."""
        spark, names = forest.sparkSession, list(forest.featureNames)
        points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(itertools.product(*(linspace(*a) for a in axes)))], ", ".join(["at int", *(f"`{n}` double" for n in names)]))
        values = [r["prediction"] for r in of_forest(forest, points, names).orderBy("at").collect()]  # as many as the grid has points
        return cls(inputs, axes, values, rate_unit, real_world)

    def energy(self, o, state: dict, rate=None):
        """Energy over the edge's distance, in the state's unit; at ``rate`` instead of the predicted one if given."""
        energy_unit, distance_unit = units.RATES[self.rate_unit]
        if rate is None:
            at = [units.convert(state[name], kind, units.DEFAULTS.get(kind, unit) if kind != "custom" else unit, unit) for name, kind, unit in self.inputs]
            rate = o.grid(self.values, self.axes, at) * self.real_world
        distance = units.convert(state["edge_distance"], "distance", "miles", distance_unit)
        return units.convert(rate * distance, "energy", energy_unit, "gallons_gasoline_equivalent")


class Forest:
    """A fitted random forest and the columns that it looks at."""

    def __init__(self, model, names: list[str], spark):
        self.model, self.featureNames, self.sparkSession = model, names, spark


def fitted_forest(rows, features: list[str], rate: str, trees: int = 20, depth: int = 8, seed: int = 42) -> Forest:
    """A random forest that predicts ``rate`` from the columns ``features``, fitted on the cluster."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    # The fit keeps a task's rows as objects: they are dealt so that there are not too many of them, however large the table.
    dealt = spread(rows.select(*features, rate), tag="training")
    vectors = VectorAssembler(inputCols=features, outputCol="__features").transform(dealt)
    return Forest(RandomForestRegressor(featuresCol="__features", labelCol=rate, numTrees=trees, maxDepth=depth, seed=seed).fit(vectors), features, rows.sparkSession)


def of_forest(forest: Forest, rows, features: list[str]):
    """The rows with the forest's ``prediction``."""
    from pyspark.ml.feature import VectorAssembler

    return forest.model.transform(VectorAssembler(inputCols=features, outputCol="__features").transform(rows)).drop("__features")


def best_rate_sql() -> str:
    """Samples for the best-case rate search: speed 1 to 100 mph, grade -20 to 0 percent by 0.2, temperature 0 to 110 °F by 10."""
    return "SELECT v AS speed, -0.2 * g AS grade, 10.0 * t AS temperature FROM (SELECT explode(sequence(1, 100)) AS v) LATERAL VIEW explode(sequence(0, 100)) AS g LATERAL VIEW explode(sequence(0, 11)) AS t"


def best_rate(spark, prediction: Prediction) -> float:
    """The least rate over all samples, and at least 0."""
    from pyspark.sql import functions as F

    from wayfold.operators.models import Columns

    samples = {"speed": ("speed", "mph"), "ratio": ("grade", "percent"), "temperature": ("temperature", "fahrenheit")}
    at = [units.convert(F.col(samples[kind][0]).cast("double"), kind, samples[kind][1], unit) for _, kind, unit in prediction.inputs]
    rate = Columns.grid(prediction.values, prediction.axes, at) * prediction.real_world
    return max(0.0, float(spark.sql(best_rate_sql()).agg(F.min(rate)).first()[0]))


@dataclass
class IceEnergy(TraversalModel):
    prediction: Prediction = None

    def __post_init__(self):
        if self.prediction.rate_unit not in ("gallons_gasoline_per_mile", "gallons_diesel_per_mile"):
            raise ModelError("an engine burns gasoline or diesel for each mile")
        self.inputs = ["edge_distance", *(x[0] for x in self.prediction.inputs)]
        self.outputs = [Feature("edge_energy_liquid", "energy"), Feature("trip_energy_liquid", "energy", True)]

    def _with(self, energy, state):
        return {"edge_energy_liquid": energy, "trip_energy_liquid": state["trip_energy_liquid"] + energy}

    def traverse(self, o, edge, state, q):
        return self._with(self.prediction.energy(o, state), state)

    def estimate(self, o, pair, state, q):
        return self._with(self.prediction.energy(o, state, self.prediction.best_rate), state)


def start_soc(q: dict, default: float = 100.0) -> float:
    """The starting charge (0 to 1) of a request's ``starting_soc_percent``."""
    percent = q.get("starting_soc_percent")
    percent = default if percent is None else percent
    if not 0 <= percent <= 100:
        raise ModelError(f"starting_soc_percent {percent} is not within 0 and 100")
    return percent / 100.0


def soc_after(o, soc, energy, capacity):
    """Charge after using ``energy`` (negative: gaining), within 0 and 1."""
    return o.least(o.greatest(soc - energy / capacity, 0.0), 1.0)


@dataclass
class BevEnergy(TraversalModel):
    prediction: Prediction = None
    capacity_kwh: float = 60.0
    initial_soc: float = 1.0
    history = True

    def __post_init__(self):
        self.inputs = ["edge_distance", *(x[0] for x in self.prediction.inputs)]
        self.outputs = [
            Feature("edge_energy_electric", "energy", output_unit="kilowatt_hours"), Feature("trip_energy_electric", "energy", True, output_unit="kilowatt_hours"),
            Feature("trip_soc", "ratio", True, self.initial_soc, "percent"), Feature("battery_capacity", "energy", False, self.capacity_kwh * KWH, "kilowatt_hours"),
        ]

    def _with(self, o, energy, state):
        return {"edge_energy_electric": energy, "trip_energy_electric": state["trip_energy_electric"] + energy, "trip_soc": soc_after(o, state["trip_soc"], energy, self.capacity_kwh * KWH)}

    def traverse(self, o, edge, state, q):
        return self._with(o, self.prediction.energy(o, state), state)

    def estimate(self, o, pair, state, q):
        return self._with(o, self.prediction.energy(o, state, self.prediction.best_rate), state)


@dataclass
class PhevEnergy(TraversalModel):
    """Battery until it is empty, then the engine: on the edge where it runs out, for the part of the edge that is left."""

    depleting: Prediction = None
    sustaining: Prediction = None
    capacity_kwh: float = 12.0
    initial_soc: float = 1.0
    history = True

    def __post_init__(self):
        self.inputs = ["edge_distance", *{x[0] for p in (self.depleting, self.sustaining) for x in p.inputs}]
        self.outputs = [
            Feature("edge_energy_electric", "energy", output_unit="kilowatt_hours"), Feature("trip_energy_electric", "energy", True, output_unit="kilowatt_hours"),
            Feature("edge_energy_liquid", "energy"), Feature("trip_energy_liquid", "energy", True), Feature("trip_soc", "ratio", True, self.initial_soc, "percent"),
            Feature("battery_capacity", "energy", False, self.capacity_kwh * KWH, "kilowatt_hours"),
        ]

    def _mixed(self, o, state, electric, liquid):
        capacity = self.capacity_kwh * KWH
        held = state["trip_soc"] * capacity
        enough = electric <= held
        share = o.where(enough, o.lit(0.0), 1.0 - held / o.where(enough, o.lit(1.0), electric))
        used, burnt = o.where(enough, electric, held), liquid * share
        return {
            "edge_energy_electric": used, "trip_energy_electric": state["trip_energy_electric"] + used, "edge_energy_liquid": burnt,
            "trip_energy_liquid": state["trip_energy_liquid"] + burnt, "trip_soc": soc_after(o, state["trip_soc"], used, capacity),
        }

    def traverse(self, o, edge, state, q):
        return self._mixed(o, state, self.depleting.energy(o, state), self.sustaining.energy(o, state))

    def estimate(self, o, pair, state, q):
        return self._mixed(o, state, self.depleting.energy(o, state, self.depleting.best_rate), self.sustaining.energy(o, state, self.sustaining.best_rate))


@dataclass
class SimpleCharging(TraversalModel):
    """At an edge's end with a station, below the threshold and of an allowed type: charge to full, and take the time."""

    threshold: float = 0.2
    full: float = 1.0
    power_types: list[str] | None = None
    inputs: list = field(default_factory=lambda: ["trip_soc", "battery_capacity", "edge_time", "trip_time"])
    history = True

    def __post_init__(self):
        self.outputs = [Feature("edge_charging_time", "time"), Feature("edge_time", "time"), Feature("trip_time", "time", True), Feature("trip_soc", "ratio", True, output_unit=None)]

    def traverse(self, o, edge, state, q):
        kw, kind = edge["station_kw"], edge["station_type"]
        here = o.both(o.either(o.absent(kw), o.absent(kind)) == o.lit(False), state["trip_soc"] < self.threshold)
        if self.power_types is not None:
            allowed = kind.isin(self.power_types) if hasattr(kind, "isin") else kind in self.power_types
            here = o.both(here, allowed)
        hours = (self.full - state["trip_soc"]) * (state["battery_capacity"] / KWH) / o.where(here, kw, o.lit(1.0))
        minutes = o.where(here, hours * 60.0, o.lit(0.0))
        return {"edge_charging_time": minutes, "edge_time": state["edge_time"] + minutes, "trip_time": state["trip_time"] + minutes, "trip_soc": o.where(here, o.lit(self.full), state["trip_soc"])}


def vehicle_from_json(text: str, grids: dict[str, list[float]]) -> tuple[str, str, dict]:
    """(name, type, predictions) of a vehicle file. Serialized regressors are not readable, so ``grids`` supplies the values."""
    made = json.loads(text)

    def prediction(part: dict) -> Prediction:
        inputs, axes = [], []
        bounds = part["model_type"]["interpolate"]
        for k, f in enumerate(part["input_features"]):
            kind = {"speed": "speed", "grade": "ratio", "ratio": "ratio", "temperature": "temperature"}.get(f.get("type", f.get("name")), "custom")
            name = f.get("name", {"speed": "edge_speed", "ratio": "edge_grade", "temperature": "ambient_temperature"}.get(kind))
            inputs.append((name, kind, f["unit"]))
            b = bounds["feature_bounds"][f.get("name", name)] if "feature_bounds" in bounds else bounds["axes"][k]
            axes.append((b["lower_bound"], b["upper_bound"], b["num_bins"]))
        return Prediction(inputs, axes, grids[part["name"]], part["energy_rate_unit"], part.get("real_world_energy_adjustment", 1.0), part.get("a_star_heuristic_energy_rate"))

    if made["type"] == "ice":
        parts = {"prediction": prediction(made)}
    elif made["type"] == "bev":
        parts = {"prediction": prediction(made), "capacity_kwh": units.convert(made["battery_capacity"], "energy", made.get("battery_capacity_unit", "kwh"), "kwh")}
    elif made["type"] == "phev":
        parts = {"depleting": prediction(made["charge_depleting"]), "sustaining": prediction(made["charge_sustaining"]), "capacity_kwh": units.convert(made["battery_capacity"], "energy", made.get("battery_capacity_unit", "kwh"), "kwh")}
    else:
        raise ModelError(f"unknown vehicle type '{made['type']}'")
    return made["name"], made["type"], parts


class VehicleLibrary:
    """Vehicles by name; a request's ``model_name`` picks one."""

    def __init__(self, vehicles: dict[str, tuple[str, dict]]):
        self.vehicles = vehicles

    @classmethod
    def read(cls, spark, path: str, grids: dict[str, list[float]]) -> VehicleLibrary:
        """Reads every JSON file under ``path`` (a library of vehicles is small)."""
        rows = spark.read.text(path, wholetext=True).collect()
        return cls({name: (kind, parts) for name, kind, parts in (vehicle_from_json(r["value"], grids) for r in rows)})

    def model(self, q: dict) -> TraversalModel:
        name = q.get("model_name")
        if name is None:
            raise ModelError("the request has no model_name")
        if name not in self.vehicles:
            raise ModelError(f"unknown vehicle '{name}'; there are {sorted(self.vehicles)}")
        kind, parts = self.vehicles[name]
        if kind == "ice":
            return IceEnergy(**parts)
        return (BevEnergy if kind == "bev" else PhevEnergy)(initial_soc=start_soc(q), **parts)
