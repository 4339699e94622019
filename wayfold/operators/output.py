"""What is said about routes and trees: summaries, formats, run figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import units
from wayfold.functions.geo import line_wkb, line_wkt, multiline_hex, multiline_wkt
from wayfold.operators.graph import KEY
from wayfold.operators.models import Feature

SUMMARIES = ("sum", "avg", "last", "first", "min", "max")


def summary_op(name: str, how: str) -> Column:
    value = F.col(f"state.{name}")
    if how == "sum":
        return F.sum(value)
    if how == "avg":
        return F.avg(value)
    if how == "last":
        return F.max_by(value, "pos")
    if how == "first":
        return F.min_by(value, "pos")
    if how in ("min", "max"):
        return getattr(F, how)(value)
    raise ValueError(f"unknown summary '{how}'")


def path_summary(routes: DataFrame, features: list[Feature], ops: dict[str, str] | None = None) -> DataFrame:
    """query_id, route_idx, a value for each feature in its output unit, and the route's costs.

    Accumulators give their last value and others their sum, unless ``ops`` says otherwise.
    """
    made = []
    for f in features:
        value = summary_op(f.name, (ops or {}).get(f.name, "last" if f.accumulator else "sum"))
        if f.output_unit and f.kind in units.DEFAULTS:
            value = units.convert(value, f.kind, units.DEFAULTS[f.kind], f.output_unit)
        made.append(value.alias(f.name))
    return routes.groupBy("query_id", "route_idx").agg(*made, F.count("*").alias("n_edges"), *route_cost())


def route_cost() -> list[Column]:
    return [F.sum("total_cost").alias("total_cost"), F.sum("objective_cost").alias("objective_cost")]


def state_in_output_units(state: str, features: list[Feature], final: bool = False) -> Column:
    """The state as a struct in output units; of the final state, the accumulators only."""
    return F.struct(*[(units.convert(F.col(f"{state}.{f.name}"), f.kind, units.DEFAULTS[f.kind], f.output_unit) if f.output_unit and f.kind in units.DEFAULTS else F.col(f"{state}.{f.name}")).alias(f.name) for f in features if f.accumulator or not final])


def with_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    return rows.join(lines.select(*KEY, "line"), KEY, "left")


def _in_order(column: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("pos", *KEY, column.alias("v")))), lambda x: x["v"])


def feature(features: list[Feature]) -> Column:
    """A GeoJSON feature for an edge: its line; ids, the whole state and costs as properties."""
    at = F.transform("line", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    return F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), at.alias("coordinates")).alias("geometry"),
        F.struct("edge_id", "edge_list_id", state_in_output_units("state", features).alias("state"), F.struct("objective_cost", "total_cost").alias("cost")).alias("properties"),
    )


def route_output(routes: DataFrame, form: str, features: list[Feature], lines: DataFrame | None = None) -> DataFrame:
    """query_id, route_idx, route: wkt, wkb, json, geo_json or edge_id (list, edge) of each route."""
    if form == "edge_id":
        return routes.groupBy("query_id", "route_idx").agg(F.to_json(_in_order(F.struct("edge_list_id", "edge_id"))).alias("route"))
    if form == "json":
        row = F.struct("edge_list_id", "edge_id", F.struct("objective_cost", "total_cost").alias("cost"), state_in_output_units("state", features).alias("result_state"))
        return routes.groupBy("query_id", "route_idx").agg(F.to_json(_in_order(row)).alias("route"))
    rows = with_lines(routes, lines)
    if form == "geo_json":
        return rows.groupBy("query_id", "route_idx").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), _in_order(feature(features)).alias("features"))).alias("route"))
    points = rows.groupBy("query_id", "route_idx").agg(F.flatten(_in_order(F.col("line"))).alias("points"))
    if form == "wkt":
        return points.select("query_id", "route_idx", line_wkt(F.col("points")).alias("route"))
    if form == "wkb":
        return points.select("query_id", "route_idx", F.hex(line_wkb("points")).alias("route"))
    raise ValueError(f"unknown route format '{form}'")


def tree_output(tree: DataFrame, form: str, features: list[Feature], lines: DataFrame | None = None) -> DataFrame:
    """query_id, tree: wkt, wkb (one multi-line each, in hexadecimal), json, geo_json, edge_id or multipoint of all edges of each tree."""
    rows = tree.filter("edge_id IS NOT NULL").withColumn("pos", F.struct("g", "vertex_id", "bin"))
    if form == "edge_id":
        return rows.groupBy("query_id").agg(F.to_json(_in_order(F.struct("edge_list_id", "edge_id"))).alias("tree"))
    if form == "json":
        node = F.struct("vertex_id", "bin", "parent_vertex", "edge_list_id", "edge_id", "g", "objective_cost", "total_cost", state_in_output_units("state", features).alias("state"))
        return rows.groupBy("query_id").agg(F.to_json(_in_order(node)).alias("tree"))
    rows = with_lines(rows, lines)
    if form == "geo_json":
        return rows.groupBy("query_id").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), _in_order(feature(features)).alias("features"))).alias("tree"))
    if form == "wkt":
        return rows.groupBy("query_id").agg(multiline_wkt(_in_order(F.col("line"))).alias("tree"))
    if form == "wkb":
        return rows.groupBy("query_id").agg(multiline_hex(_in_order(F.hex(line_wkb("line")))).alias("tree"))
    if form == "multipoint":
        end = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
        return rows.groupBy("query_id").agg(F.concat(F.lit("MULTIPOINT ("), F.array_join(F.transform(_in_order(F.element_at("line", -1)), end), ", "), F.lit(")")).alias("tree"))
    raise ValueError(f"unknown tree format '{form}'")


def by_cardinality(outputs: DataFrame, column: str = "route") -> DataFrame:
    """One row for each request: null without a route, the route alone, or an array of them, as JSON text."""
    grouped = outputs.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("route_idx", column))), lambda x: x[column]).alias("all"))
    text = F.when(F.size("all") == 1, F.col("all")[0]).when(F.size("all") > 1, F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")))
    return grouped.select("query_id", text.alias(column))


def run_summary(tree: DataFrame, routes: DataFrame, requests: DataFrame) -> DataFrame:
    """query_id, tree_size, route_edges, n_routes, iterations for every request: an iteration is a step of the search from one
    label's ways to those of the next, so they are as many as the most edges of a way in its tree."""
    t = tree.groupBy("query_id").agg(F.count("edge_id").alias("tree_size"), F.max("depth").cast("long").alias("iterations"))
    r = routes.groupBy("query_id").agg(F.count("*").alias("route_edges"), F.count_distinct("route_idx").alias("n_routes"))
    return requests.select("query_id").join(t, "query_id", "left").join(r, "query_id", "left").na.fill(0, ["tree_size", "iterations", "route_edges", "n_routes"])


def responses(requests: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """query_id, response: ``{request, ...output columns}`` or ``{request, error}`` as JSON text."""
    rows = requests if outputs is None else requests.join(outputs, "query_id", "left")
    extra = [c for c in rows.columns if c not in ("query_id", "request", "error")]
    good = F.to_json(F.struct(F.col("request").alias("request"), *extra))
    bad = F.to_json(F.struct(F.col("request").alias("request"), F.col("error").alias("error")))
    return rows.select("query_id", F.when(F.col("error").isNotNull(), bad).otherwise(good).alias("response"))


def with_uuids(requests: DataFrame, uuids: DataFrame) -> DataFrame:
    """Adds origin_uuid and destination_uuid from (vertex_id, uuid)."""
    for side in ("origin", "destination"):
        requests = requests.join(uuids.select(F.col("vertex_id").alias(side), F.col("uuid").alias(f"{side}_uuid")), side, "left")
    return requests
