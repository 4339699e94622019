"""Builders by name: what a configuration's ``type`` may say, and what users add."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from wayfold.operators import constraints, energy, labels, models, shaping
from wayfold.sources import files

KINDS = ("traversal", "constraint", "label", "input", "output", "prediction")


class Registry:
    """``build(kind, spec, context)`` makes a model of a specification; ``register`` adds a builder."""

    def __init__(self) -> None:
        self.builders: dict[str, dict[str, Callable[[dict, Any], Any]]] = {k: {} for k in KINDS}

    def register(self, kind: str, name: str, builder: Callable[[dict, Any], Any]) -> None:
        if kind not in self.builders:
            raise ValueError(f"unknown kind '{kind}'")
        self.builders[kind][name] = builder

    def build(self, kind: str, spec: dict, context: Any = None) -> Any:
        name = spec.get("type")
        if name == "combined" and kind in ("traversal", "constraint"):
            made = [self.build(kind, s, context) for s in spec.get("models", [])]
            return [m for x in made for m in (x if isinstance(x, list) else [x])] if kind == "traversal" else constraints.Combined(made)
        if name not in self.builders[kind]:
            raise ValueError(f"unknown {kind} type '{name}'; there are {sorted(self.builders[kind])}")
        return self.builders[kind][name](spec, context)

    def names(self) -> dict[str, list[str]]:
        return {k: sorted(v) for k, v in self.builders.items()}


def default_registry() -> Registry:
    r = Registry()
    t = lambda name, f: r.register("traversal", name, f)
    t("distance", lambda s, c: models.Distance(s.get("include_trip_distance", True)))
    t("speed", lambda s, c: models.Speed(s.get("column", "speed_kph"), s.get("speed_unit", "kph"), s.get("fastest_mph")))
    t("time", lambda s, c: models.Time(s.get("include_trip_time", True)))
    t("grade", lambda s, c: models.Grade(s.get("column", "grade"), s.get("grade_unit", "decimal")))
    t("elevation", lambda s, c: models.Elevation())
    t("temperature", lambda s, c: models.Temperature(s.get("default_ambient_temperature")))
    t("turn_delay", lambda s, c: models.TurnDelay(s["table"]))
    t("custom", lambda s, c: models.Custom(s["name"], s.get("column", s["name"]), s.get("boolean", False), s.get("accumulator", False), s.get("initial", 0.0)))
    t("energy", lambda s, c: c["vehicles"].model(c.get("q", {})))
    t("simple_charging", lambda s, c: energy.SimpleCharging(s.get("starting_soc_threshold_percent", 20.0) / 100.0, s.get("full_soc_percent", 100.0) / 100.0, (c or {}).get("q", {}).get("valid_power_types", s.get("valid_power_types"))))
    k = lambda name, f: r.register("constraint", name, f)
    k("no_restriction", lambda s, c: constraints.NoRestriction())
    k("road_class", lambda s, c: constraints.RoadClass((c or {}).get("q", {}).get("road_classes"), s.get("column", "road_class")))
    k("turn_restriction", lambda s, c: constraints.TurnRestriction(c["turn_restrictions"]))
    k("vehicle_restriction", lambda s, c: constraints.VehicleRestriction(c["vehicle_restrictions"], vehicle_parameters(c.get("q", {}).get("vehicle_parameters"))))
    k("battery_frontier", lambda s, c: constraints.Battery(s.get("soc_lower_bound_percent", 0.0) / 100.0))
    r.register("label", "vertex", lambda s, c: labels.VertexLabel())
    r.register("label", "soc", lambda s, c: labels.SocBins(s.get("bins") or [float(x) for x in range(10, 101, 10)]))
    i = lambda name, f: r.register("input", name, f)
    i("grid_search", lambda s, c: shaping.grid_search)
    i("inject", lambda s, c: _injection(s))
    i("load_balancer", lambda s, c: _balancer(s["weight_heuristic"]))
    i("debug", lambda s, c: shaping.debug)
    o = lambda name, f: r.register("output", name, f)
    o("summary", lambda s, c: ("summary", s))
    o("traversal", lambda s, c: ("traversal", s))
    o("uuid", lambda s, c: ("uuid", s))
    return r


def vehicle_parameters(given: list | None) -> list[tuple[str, float, str]] | None:
    """(name, value, unit) of a request's list of objects with ``type``, ``value`` and ``unit``."""
    if given is None:
        return None
    try:
        return [(g["type"], float(g["value"]), g["unit"]) if isinstance(g, dict) else tuple(g) for g in given]
    except (KeyError, TypeError, ValueError) as e:
        raise constraints.ConstraintError(f"vehicle_parameters need type, value and unit: {e}") from e


def _injection(spec: dict):
    """A constant under a key, or the value of the polygon that holds the request's origin or destination."""
    mode = spec.get("write_mode", "overwrite")
    if "spatial_input_file" not in spec:
        return lambda df: shaping.inject_constant(df, spec["key"], spec["value"], mode)
    side = spec.get("orientation", "origin")
    if side not in ("origin", "destination"):
        raise ValueError(f"unknown orientation '{side}'")
    return lambda df: shaping.inject_by_polygon(df, files.read_polygons(df.sparkSession, spec["spatial_input_file"], spec.get("source_key")), spec["key"], side, spec.get("default"), mode)


def _balancer(spec: dict):
    kind = spec.get("type")
    if kind == "haversine":
        return shaping.weight_haversine
    custom = spec["custom_weight_type"]
    if custom.get("type") == "numeric":
        return lambda df: shaping.weight_numeric(df, spec.get("column_name", custom.get("column_name")))
    return lambda df: shaping.weight_categorical(df, spec.get("column_name", custom.get("column_name")), custom["mapping"], custom.get("default"))
