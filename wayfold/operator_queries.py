"""More queries with DuckDB SQL for the same rows: sources and sinks by round trip, and operators that ``queries`` does not reach.

Files are written to the folder for intermediate tables and read back by the sources.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.app import REQUEST, App
from wayfold.functions import geo, text, units
from wayfold.operators import constraints, cost, energy, graph, labels, matching, models, output, shaping
from wayfold.operators.constraints import Battery, Combined, Constraint, EdgeCut, NoRestriction, RoadClass
from wayfold.operators.cost import CostModel, Rate
from wayfold.operators.models import Columns, Feature, TraversalModel
from wayfold.plans import ksp, paths
from wayfold.plans.scratch import materialise, scratch_dir
from wayfold.plans.search import Setup, trees
from wayfold.queries import HAVERSINE, NATIONS, NET, POINTS, RATE, ROUTE, SEARCH, SUPPLIERS, _edges, _g, _grid, _metres, _network, _order_responses, _points, _requests, _routes, _stepped, _supplier_requests, _trees, net, query, relaxed_sql
from wayfold.registry import default_registry
from wayfold.sources import config as cfg
from wayfold.sources import dataset, files, sinks
from wayfold.sources.derived import derived_network, tables


def _path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/wayfold/{tag}-{uuid.uuid4().hex}"


def _with(sql: str, *more: str) -> str:
    return f"WITH {NET.strip()}, {', '.join(more)}\n{sql}"


# -- sources ----------------------------------------------------------------------------------------------------------------


@query(net("SELECT 0 AS edge_list_id, edge_id, src, dst, distance_m FROM E UNION ALL SELECT 1, edge_id, dst, src, distance_m FROM E"))
def csv_edges(spark, sf_dir):
    """Two edge lists as CSV with columns in another order, one of them compressed."""
    e, one, two = _edges(spark, sf_dir), _path(spark, "csv"), _path(spark, "csv")
    row = lambda a, b: e.select(F.col("distance_m").alias("distance"), F.col(b).alias("dst_vertex_id"), F.lit("x").alias("note"), F.col(a).alias("src_vertex_id"), "edge_id")
    row("src", "dst").write.option("header", True).csv(one)
    row("dst", "src").write.option("header", True).option("compression", "gzip").csv(two)
    return files.read_edges(spark, [one, two])


@query(net("SELECT vertex_id, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 5) AS y FROM V"))
def csv_vertices(spark, sf_dir):
    at = _path(spark, "csv")
    _network(spark, sf_dir).vertices.write.option("header", True).csv(at)
    return files.read_vertices(spark, at).select("vertex_id", F.round(F.col("x").cast("double"), 5).alias("x"), F.round(F.col("y").cast("double"), 5).alias("y"))


def _numbered_lines(rows: DataFrame, key: str, value, tag: str) -> str:
    """A file of the values in order of a key."""
    at = _path(rows.sparkSession, tag)
    rows.orderBy(key).select(value.cast("string")).write.text(at)
    return at


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS \"row\", p_name AS value FROM part")
def file_lines(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return files.read_lines(spark, _numbered_lines(part, "p_partkey", F.col("p_name"), "lines"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 300 <= 255 THEN p_partkey % 300 END AS u8, p_retailprice AS f64, p_partkey - 50 AS i64, CASE WHEN p_partkey >= 50 THEN p_partkey - 50 END AS u64, p_size % 2 = 0 AS bool FROM part")
def decoded_values(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    at = lambda c, kind: files.decode(F.concat(F.lit(" "), c.cast("string"), F.lit(" ")), kind)
    k = F.col("p_partkey")
    return part.select("p_partkey", at(k % 300, "u8").alias("u8"), at(F.col("p_retailprice"), "f64").alias("f64"), at(k - 50, "i64").alias("i64"), at(k - 50, "u64").alias("u64"), at(F.col("p_size") % 2 == 0, "bool").alias("bool"))


@query(net("SELECT row_number() OVER (ORDER BY edge_id) - 1 AS edge_id, speed_kph AS value FROM E"))
def attribute_file(spark, sf_dir):
    return files.read_attribute(spark, _numbered_lines(_edges(spark, sf_dir), "edge_id", F.col("speed_kph"), "speeds"), "f64").select("edge_id", "value")


@query(net("SELECT row_number() OVER (ORDER BY edge_id) - 1 AS edge_id, 2 AS n, round(CAST(CAST(src_x AS FLOAT) AS DOUBLE), 4) AS x, round(CAST(CAST(dst_y AS FLOAT) AS DOUBLE), 4) AS y FROM T"))
def geometry_lines(spark, sf_dir):
    n = derived_network(spark, sf_dir)  # written once: sorting, the lines and their number all read it
    lines = n.straight_lines().select("edge_id", geo.line_wkt(F.col("line")).alias("wkt"))
    made = files.read_lines_of_edges(spark, _numbered_lines(lines, "edge_id", F.col("wkt"), "lines"), n)
    return made.select("edge_id", F.size("line").alias("n"), F.round(F.col("line")[0]["x"].cast("double"), 4).alias("x"), F.round(F.col("line")[1]["y"].cast("double"), 4).alias("y"))


@query(net("SELECT edge_id, round(CAST(CAST(src_x AS FLOAT) AS DOUBLE), 4) AS x0, round(CAST(CAST(src_y AS FLOAT) AS DOUBLE), 4) AS y0, round(CAST(CAST(dst_x AS FLOAT) AS DOUBLE), 4) AS x1, round(CAST(CAST(dst_y AS FLOAT) AS DOUBLE), 4) AS y1 FROM T"))
def wkb_lines(spark, sf_dir):
    made = _network(spark, sf_dir).straight_lines().select("edge_id", geo.points_of_wkb(geo.line_wkb("line")).alias("p"))
    at = lambda i, c: F.round(F.col("p")[i][c].cast("double"), 4)
    return made.select("edge_id", at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(1, "x").alias("x1"), at(1, "y").alias("y1"))


ZONE = "CASE WHEN dx > -104.95 AND dx < -104.55 AND dy > 39.05 AND dy < 39.35 THEN 'first' WHEN dx > -104.75 AND dx < -104.35 AND dy > 39.15 AND dy < 39.45 THEN 'second' END"


@query(f"WITH {SUPPLIERS} SELECT query_id, coalesce({ZONE}, 'none') AS zone FROM S")
def geojson_injection(spark, sf_dir):
    """Polygons of a GeoJSON file, injected as a configuration says."""
    ring = lambda x, y: [[[x, y], [x + 0.4, y], [x + 0.4, y + 0.3], [x, y + 0.3], [x, y]]]
    features = [("first", {"type": "Polygon", "coordinates": ring(-104.95, 39.05)}), ("second", {"type": "MultiPolygon", "coordinates": [ring(-104.75, 39.15)]})]
    made = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n, "other": 1}, "geometry": g} for n, g in features]})
    at = _path(spark, "geojson")
    spark.createDataFrame([(made,)], "value string").coalesce(1).write.text(at)
    plugin = default_registry().build("input", {"type": "inject", "spatial_input_file": at, "source_key": "name", "key": "place", "orientation": "destination", "default": "none"})
    rows = plugin(_supplier_requests(spark, sf_dir))
    return rows.select("query_id", shaping.json_value(F.col("request"), "place").alias("zone"))


@query("SELECT * FROM (VALUES ('a.b', '2'), ('a.c', '3'), ('list', '[1]'), ('missing', 'default'), ('number', '4.0')) v(key, value)")
def config_values(spark, sf_dir):
    """Layers of a configuration, typed values, and one or many."""
    made = cfg.merge({"a": {"b": 1, "c": 3}, "n": 4}, {"a": {"b": 2}, "list": 1})
    rows = [("a.b", str(cfg.get(made, "a.b", int))), ("a.c", str(cfg.section(made, "a")["c"])), ("list", str(cfg.one_or_many(cfg.get(made, "list")))), ("missing", cfg.get(made, "a.z", str, "default")), ("number", str(cfg.get(made, "n", float)))]
    return spark.createDataFrame(rows, "key string, value string")


@query(f"WITH {SUPPLIERS} SELECT query_id, s_nationkey AS load, 'n' || s_nationkey AS zone FROM S")
def json_requests(spark, sf_dir):
    """A JSON file with an array of requests."""
    at = _path(spark, "requests")
    rows = _supplier_requests(spark, sf_dir).select(F.to_json(F.struct("query_id", F.from_json("request", "load int, zone string").alias("r"))).alias("one"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("one"), ", "), F.lit("]")).alias("value")).coalesce(1).write.text(at)
    return files.read_requests(spark, at).select(F.get_json_object("request", "$.query_id").cast("long").alias("query_id"), F.get_json_object("request", "$.r.load").cast("int").alias("load"), F.get_json_object("request", "$.r.zone").alias("zone"))


@query("SELECT s_suppkey AS n, CASE WHEN s_suppkey % 7 = 0 THEN 'not JSON' END AS error FROM supplier")
def json_lines(spark, sf_dir):
    """Newline JSON with lines that are none, and empty ones."""
    (supplier,) = tables(spark, sf_dir, "supplier")
    at, k = _path(spark, "lines"), F.col("s_suppkey")
    good = F.to_json(F.struct(k.alias("n")))
    supplier.select(F.explode(F.array(F.when(k % 7 == 0, F.concat(F.lit('{"n":'), k.cast("string"))).otherwise(good), F.lit("")))).write.text(at)
    return files.read_request_lines(spark, at).select(F.regexp_extract("request", r"(\d+)", 1).cast("long").alias("n"), "error")


@query(_with("SELECT s_suppkey, vertex_id FROM (SELECT s_suppkey, vertex_id, row_number() OVER (PARTITION BY s_suppkey ORDER BY pow(-105 + CAST(s_suppkey * 131 % 997 AS DOUBLE) / 1000 - CAST(CAST(x AS FLOAT) AS DOUBLE), 2) + pow(39 + CAST(s_suppkey * 37 % 997 AS DOUBLE) / 1000 - CAST(CAST(y AS FLOAT) AS DOUBLE), 2), vertex_id) AS r FROM supplier, V) WHERE r = 1", "Z AS (SELECT 1 AS z)"))
def station_vertices(spark, sf_dir):
    """Charging stations of a file at their nearest vertices; power tells them apart."""
    (supplier,) = tables(spark, sf_dir, "supplier")
    n, k, at = _network(spark, sf_dir), F.col("s_suppkey"), _path(spark, "stations")
    single = graph.Network(n.vertices.select("vertex_id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y")), n.edges)
    rows = supplier.select(F.lit("dcfc").alias("power_type"), k.cast("double").alias("power_kw"), F.lit(0.2).alias("cost_per_kwh"), (F.lit(-105.0) + (k * 131 % 997) / 1000.0).alias("x"), (F.lit(39.0) + (k * 37 % 997) / 1000.0).alias("y"))
    rows.write.option("header", True).csv(at)
    raw = files.read_csv(spark, at, "power_type string, power_kw double, cost_per_kwh double, x double, y double")
    near = matching.nearest_vertex(raw.select(F.col("power_kw").cast("long").alias("point_id"), "x", "y"), single)
    return near.select(F.col("point_id").alias("s_suppkey"), "vertex_id")


@query(net(f"SELECT edge_id, round({RATE} * 1.1::DOUBLE * distance_m / 1609.344::DOUBLE, 6) AS gallons, round(100 * greatest(0, least(1, 0.5::DOUBLE - {RATE} * 11::DOUBLE * distance_m / 1609.344::DOUBLE / 60)), 4) AS percent FROM E"))
def vehicle_library(spark, sf_dir):
    """Vehicles out of a folder of files, picked by the request's model_name."""
    grid = _grid()
    features = [{"name": "edge_speed", "type": "speed", "unit": "mph"}, {"name": "edge_grade", "type": "grade", "unit": "percent"}]
    bounds = {"interpolate": {"feature_bounds": {"edge_speed": {"lower_bound": 0.0, "upper_bound": 100.0, "num_bins": 11}, "edge_grade": {"lower_bound": -20.0, "upper_bound": 20.0, "num_bins": 9}}}}
    car = {"name": "car", "type": "ice", "input_features": features, "model_type": bounds, "energy_rate_unit": "gallons_gasoline_per_mile", "real_world_energy_adjustment": 1.1}
    bev = car | {"name": "bev", "type": "bev", "energy_rate_unit": "kilowatt_hours_per_mile", "battery_capacity": 60.0}
    at = _path(spark, "vehicles")
    spark.createDataFrame([(json.dumps(car),), (json.dumps(bev),)], "value string").repartition(2, "value").write.option("maxRecordsPerFile", 1).text(at)
    library = energy.VehicleLibrary.read(spark, at, {"car": grid.values, "bev": [10 * v for v in grid.values]})
    chain = [models.Speed(), models.Grade(), models.Distance()]
    e, s = _stepped(spark, sf_dir, [*chain, library.model({"model_name": "car"})])
    battery = library.model({"model_name": "bev", "starting_soc_percent": 50})
    _, b = _stepped(spark, sf_dir, [*chain, battery], before={"trip_soc": F.lit(battery.initial_soc)})
    return e.select("edge_id", F.round(s["trip_energy_liquid"], 6).alias("gallons"), F.round(b["trip_soc"] * 100, 4).alias("percent"))


@query("SELECT 'L' || (k % 3) AS highway, id AS edge_id, round(CASE WHEN k % 4 > 0 THEN CAST(30 + k % 5 AS DOUBLE) ELSE coalesce(avg(CASE WHEN k % 4 > 0 THEN CAST(30 + k % 5 AS DOUBLE) END) OVER (PARTITION BY k % 3), 0) END, 6) AS speed_kph, round((CAST((k + 1) % 7 AS DOUBLE) - k % 7) / (10 + k), 6) AS grade FROM (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part))")
def dataset_edges(spark, sf_dir):
    """Numbered edges of a map table, with missing speeds from their class and grades from elevations; parallel edges go."""
    (part,) = tables(spark, sf_dir, "part")
    k, last = F.col("p_partkey"), part.agg(F.max("p_partkey")).first()[0]
    vertices = dataset.vertices_of(part.select(k.alias("osmid"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    rows = part.filter(k < last).select(k.alias("u"), (k + 1).alias("v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("key"), (k + 10).cast("double").alias("length"), F.concat(F.lit("L"), k % 3).alias("highway"), F.when(k % 4 > 0, (30 + k % 5).cast("double")).alias("maxspeed_kph"))
    elevations = vertices.select("vertex_id", (F.col("osmid") % 7).cast("double").alias("elevation_m"))
    made = dataset.grades(dataset.imputed_speeds(dataset.edges_of(rows, vertices)), elevations)
    return made.select("highway", "edge_id", F.round("speed_kph", 6).alias("speed_kph"), F.round("grade", 6).alias("grade"))


# -- sinks ------------------------------------------------------------------------------------------------------------------

MADE = "SELECT o_orderkey AS query_id, o_custkey AS a, round(o_totalprice, 4) AS price FROM orders"


def _read_back(lines: DataFrame) -> DataFrame:
    at = lambda p: F.get_json_object("value", f"$.{p}")
    return lines.select(at("id").cast("long").alias("query_id"), at("cost.a").cast("long").alias("a"), F.round(at("cost.deep.price").cast("double"), 4).alias("price"))


def _with_ids(spark, sf_dir) -> DataFrame:
    return _order_responses(spark, sf_dir).withColumn("response", F.concat(F.lit('{"id":'), F.col("query_id").cast("string"), F.lit(","), F.expr("substring(response, 2)")))


@query(MADE)
def sink_ndjson(spark, sf_dir):
    at = _path(spark, "sink")
    sinks.sink_of({"type": "file", "format": {"type": "json", "newline_delimited": True}, "filename": at}).write(_with_ids(spark, sf_dir))
    return _read_back(spark.read.text(at))


@query(MADE)
def sink_gzip(spark, sf_dir):
    at = _path(spark, "sink") + ".gz"
    sinks.sink_of({"type": "file", "format": {"type": "json", "newline_delimited": True}, "filename": at}).write(_with_ids(spark, sf_dir))
    return _read_back(spark.read.text(at))


MAPPING = {"query_id": {"path": "id", "dtype": "int"}, "a": {"path": "cost.a", "dtype": "int"}, "price": {"path": "cost.deep.price", "dtype": "float"}}


@query(MADE)
def sink_csv(spark, sf_dir):
    at = _path(spark, "sink")
    sinks.sink_of({"type": "file", "format": {"type": "csv", "mapping": {"id": "id"} | {k: MAPPING[k] for k in ("a", "price")}}, "filename": at}).write(_with_ids(spark, sf_dir))
    return files.read_csv(spark, at, "id long, a long, price double").select(F.col("id").alias("query_id"), "a", F.round("price", 4).alias("price"))


@query("SELECT o_orderkey AS query_id, json_extract_string(j, '$.a') AS a FROM (SELECT o_orderkey, json_object('a', o_custkey) AS j FROM orders)")
def sink_parquet(spark, sf_dir):
    at = _path(spark, "sink")
    sinks.sink_of({"type": "parquet", "path": at}).write(_order_responses(spark, sf_dir))
    return spark.read.parquet(at).select("query_id", F.get_json_object("response", "$.cost.a").alias("a"))


@query("SELECT 'append' AS mode, 2 * count(*) AS n FROM orders UNION ALL SELECT 'overwrite', count(*) FROM orders UNION ALL SELECT 'error', 0 UNION ALL SELECT 'none', 0")
def sink_modes(spark, sf_dir):
    """Two writes in each mode: appended, written over, refused; and a policy that writes nothing."""
    rows, made = materialise(_order_responses(spark, sf_dir), "responses"), []
    for mode in ("append", "overwrite", "error"):
        at = _path(spark, "sink")
        sink = sinks.sink_of({"type": "parquet", "path": at, "write_mode": mode})
        sink.write(rows)
        try:
            sink.write(rows)
            made.append((mode, spark.read.parquet(at).count()))
        except Exception as e:  # noqa: BLE001
            made.append((mode, 0 if "already exists" in str(e) else -1))
    sinks.sink_of(None).write(rows)
    return spark.createDataFrame([*made, ("none", 0)], "mode string, n long")


@query(MADE)
def sink_combined(spark, sf_dir):
    one, two = _path(spark, "sink"), _path(spark, "sink")
    sinks.sink_of({"type": "combined", "policies": [{"type": "parquet", "path": one}, {"type": "file", "format": {"type": "json", "newline_delimited": True}, "filename": two}]}).write(_with_ids(spark, sf_dir))
    return _read_back(spark.read.parquet(one).select(F.col("response").alias("value")).unionByName(spark.read.text(two)).distinct())


@query('SELECT o_orderkey AS query_id, o_custkey AS "cost.a", o_totalprice AS "cost.deep.price" FROM orders')
def results_table(spark, sf_dir):
    body = F.from_json("response", "cost struct<a:long,deep:struct<price:double>>")
    return sinks.flattened(_order_responses(spark, sf_dir).select("query_id", body.alias("r")).select("query_id", "r.cost"))


# -- requests ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {SUPPLIERS} SELECT query_id, 'other' AS zone, '[1,2]' AS list, s_nationkey AS load, CASE WHEN query_id % 2 = 0 THEN '''once'' is there already' END AS error FROM S")
def write_modes(spark, sf_dir):
    """Overwrite, append, and fail if existing (for every second request)."""
    rows = shaping.inject_constant(_supplier_requests(spark, sf_dir), "zone", "other", "overwrite")
    rows = shaping.inject_constant(shaping.inject_constant(rows, "list", [1]), "list", 2, "append")
    once = F.when(F.col("query_id") % 2 == 0, F.lit('"x"'))
    rows = shaping.inject_constant(shaping.inject(rows, "once", once), "once", "y", "fail_if_existing")
    at = lambda p: shaping.json_value(F.col("request"), p)
    return rows.select("query_id", at("zone").alias("zone"), F.replace(at("list"), F.lit(" "), F.lit("")).alias("list"), at("load").cast("int").alias("load"), "error")


@query("SELECT s_suppkey AS query_id, CAST(s_nationkey AS DOUBLE) AS weight FROM supplier")
def weight_numeric(spark, sf_dir):
    return shaping.weight_numeric(_supplier_requests(spark, sf_dir), "load").select("query_id", F.col("query_weight_estimate").alias("weight"))


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS q, CAST(s_nationkey AS DOUBLE) AS w, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier),
b AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS q, -1 AS bin, 0.0::DOUBLE AS t0, 0.0::DOUBLE AS t1, 0.0::DOUBLE AS t2, 0.0::DOUBLE AS t3
  UNION ALL SELECT s.n, s.q, x.k, t0 + CASE WHEN x.k = 0 THEN w ELSE 0 END, t1 + CASE WHEN x.k = 1 THEN w ELSE 0 END, t2 + CASE WHEN x.k = 2 THEN w ELSE 0 END, t3 + CASE WHEN x.k = 3 THEN w ELSE 0 END
  FROM (SELECT *, CASE WHEN t0 <= t1 AND t0 <= t2 AND t0 <= t3 THEN 0 WHEN t1 <= t2 AND t1 <= t3 THEN 1 WHEN t2 <= t3 THEN 2 ELSE 3 END AS k FROM b) x JOIN s ON s.n = x.n + 1)
SELECT q AS query_id, bin FROM b WHERE n > 0""")
def load_balance(spark, sf_dir):
    return shaping.with_bins(shaping.weight_numeric(_supplier_requests(spark, sf_dir), "load"), 4).select("query_id", "bin")


@query("SELECT s_suppkey AS query_id, least(20, (SELECT count(*) FROM supplier)) AS logged FROM supplier")
def debug_requests(spark, sf_dir):
    seen: list[str] = []
    rows = shaping.debug(_supplier_requests(spark, sf_dir), seen.append)
    return rows.select("query_id", F.lit(len(seen)).cast("long").alias("logged"))


WEIGHTS = "CASE s_suppkey % 4 WHEN 0 THEN '{\"trip_time\": 2}' WHEN 1 THEN '{\"other\": 1}' WHEN 2 THEN '{\"trip_distance\": -1}' ELSE '{\"trip_distance\": 0, \"trip_time\": 0}' END"


@query("SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN 2.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS trip_time, CASE s_suppkey % 4 WHEN 2 THEN -1.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE ELSE 5.0::DOUBLE END AS trip_distance, CASE s_suppkey % 4 WHEN 1 THEN 'weights for unknown features other' WHEN 2 THEN 'a weight is negative' WHEN 3 THEN 'all costs are zero: give a weight and a rate to some feature' END AS error FROM supplier")
def weights_merge(spark, sf_dir):
    """A request's weights before the configured ones, and what is wrong with them."""
    (supplier,) = tables(spark, sf_dir, "supplier")
    own = F.from_json(F.expr(WEIGHTS), "map<string,double>")
    rows = supplier.select(F.col("s_suppkey").alias("query_id"), shaping.merged_map({"trip_distance": 5.0, "trip_time": 1.0}, own).alias("weights"))
    features = models.features_of([models.Distance(), models.Speed(), models.Time()])
    model = CostModel({}, {"trip_distance": Rate(), "trip_time": Rate()}, own_weights=True).for_requests(features)
    return rows.select("query_id", F.try_element_at("weights", F.lit("trip_time")).alias("trip_time"), F.try_element_at("weights", F.lit("trip_distance")).alias("trip_distance"), model.weights_error(F.col("weights"), features).alias("error"))


@query("SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 3 <> 0 THEN -105.0 + s_suppkey % 10 END AS origin_x, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS destination_vertex FROM supplier")
def request_ends(spark, sf_dir):
    """Origins and destinations of requests as typed columns."""
    (supplier,) = tables(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    body = F.to_json(F.struct(F.when(k % 3 != 0, -105.0 + k % 10).alias("origin_x"), F.when(k % 3 == 0, k).alias("destination_vertex"), F.lit("x").alias("name")))
    return supplier.select(k.alias("query_id"), F.from_json(body, REQUEST).alias("r")).select("query_id", "r.origin_x", "r.destination_vertex")


# -- constraints ------------------------------------------------------------------------------------------------------------


@query(net("SELECT edge_id FROM E WHERE road_class = 'A' AND src % 5 <> 0"))
def combined_constraints(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return Combined([NoRestriction(), RoadClass(["A"]), EdgeCut(e.filter("src % 5 = 0"))]).prefilter(e).select("edge_id")


@query(net("SELECT edge_id FROM E"))
def no_restriction(spark, sf_dir):
    return NoRestriction().prefilter(_edges(spark, sf_dir)).select("edge_id")


@query(net("SELECT edge_id FROM E WHERE edge_id NOT IN (SELECT edge_id FROM E WHERE distance_m > 2500)"))
def edge_cut(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return EdgeCut(e.filter("distance_m > 2500").select("edge_list_id", "edge_id")).prefilter(e).select("edge_id")


@query(net("SELECT edge_id FROM E WHERE distance_m / 5000 > 0.25::DOUBLE"))
def battery_frontier(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return e.filter(Battery(0.25).allows(Columns, {}, {"trip_soc": F.col("distance_m") / 5000})).select("edge_id")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 1")
def station_types(spark, sf_dir):
    (supplier,) = tables(spark, sf_dir, "supplier")
    kinds = F.element_at(F.array(F.lit("L1"), F.lit("L2"), F.lit("DCFC")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return constraints.stations_of_types(supplier.withColumn("power_type", kinds), ["dcfc", "l1"]).select("s_suppkey")


# -- models -----------------------------------------------------------------------------------------------------------------


@query(net("SELECT edge_id, round(0.5::DOUBLE + 0.02::DOUBLE * least(greatest(speed_kph, 0), 100), 6) AS one, round(1 + 2 * least(greatest(speed_kph / 10, 0), 8) + 3 * least(greatest(grade, -1), 1) + 4 * least(greatest(distance_m / 1000, 0), 4), 6) AS three FROM E"))
def interp_1d_3d(spark, sf_dir):
    one = energy.Prediction.of_function(lambda v: 0.5 + 0.02 * v, [("v", "custom", "kph")], [(0.0, 100.0, 6)], "gallons_gasoline_per_mile")
    three = energy.Prediction.of_function(lambda v, g, d: 1 + 2 * v + 3 * g + 4 * d, [("v", "custom", "x")] * 3, [(0.0, 8.0, 5), (-1.0, 1.0, 3), (0.0, 4.0, 4)], "gallons_gasoline_per_mile")
    v, g, d = F.col("speed_kph"), F.col("grade"), F.col("distance_m")
    return _edges(spark, sf_dir).select("edge_id", F.round(Columns.grid(one.values, one.axes, [v]), 6).alias("one"), F.round(Columns.grid(three.values, three.axes, [v / 10, g, d / 1000]), 6).alias("three"))


@query("SELECT CAST(v AS DOUBLE) AS speed, CAST(g AS DOUBLE) AS grade, TRUE AS alike FROM (VALUES (0), (20), (40), (60), (80), (100)) a(v), (VALUES (-20), (-10), (0), (10), (20)) b(g)")
def forest_prediction(spark, sf_dir):
    """A random forest, fitted on the edges and tabulated: at the grid's points the table is the forest."""
    train = _edges(spark, sf_dir).select((F.col("speed_kph") / 1.609344).alias("speed"), (F.col("grade") * 100).alias("grade"), (0.02 + 0.00002 * F.col("speed_kph") * (F.col("grade") * 100 + 20)).alias("rate"))
    forest = energy.fitted_forest(train, ["speed", "grade"], "rate", trees=10, depth=5, seed=7)
    inputs = [("edge_speed", "speed", "mph"), ("edge_grade", "ratio", "percent")]
    p = energy.Prediction.of_forest(forest, inputs, [(0.0, 100.0, 6), (-20.0, 20.0, 5)], "gallons_gasoline_per_mile")
    points = spark.range(6).select((F.col("id") * 20.0).alias("speed")).join(F.broadcast(spark.range(5).select((F.col("id") * 10.0 - 20).alias("grade"))))
    both = energy.of_forest(forest, points, ["speed", "grade"]).withColumn("table", Columns.grid(p.values, p.axes, [F.col("speed"), F.col("grade")]))
    return both.select("speed", "grade", (F.abs(F.col("prediction") - F.col("table")) < 1e-12).alias("alike"))


class Toll(TraversalModel):
    """A user's model: a toll for each edge by its class."""

    def __init__(self):
        self.outputs = [Feature("trip_toll", "custom", True)]

    def traverse(self, o, edge, state, q):
        return {"trip_toll": state["trip_toll"] + o.choose(edge["road_class"], {"A": 2.0, "R": 0.5}, 1.0)}


class Short(Constraint):
    """A user's constraint: edges up to a length."""

    def prefilter(self, edges):
        return edges.filter("distance_m <= 4000")


@query(net("SELECT edge_id, CASE road_class WHEN 'A' THEN 2.0::DOUBLE WHEN 'R' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS toll FROM E WHERE distance_m <= 4000"))
def registered_models(spark, sf_dir):
    """A traversal model and a constraint that a user registers under names of their own."""
    r = default_registry()
    r.register("traversal", "toll", lambda s, c: Toll())
    r.register("constraint", "short", lambda s, c: Short())
    chain = r.build("traversal", {"type": "combined", "models": [{"type": "toll"}, {"type": "distance"}]})
    e, s = _stepped(spark, sf_dir, chain)
    return r.build("constraint", {"type": "short"}).prefilter(e.withColumn("toll", s["trip_toll"])).select("edge_id", "toll")


@query(net("SELECT edge_id, CASE WHEN distance_m / 50 <= 10 THEN 0 WHEN distance_m / 50 <= 50 THEN 1 ELSE 2 END AS bin FROM E"))
def soc_bins(spark, sf_dir):
    return _edges(spark, sf_dir).select("edge_id", labels.SocBins([10.0, 50.0, 100.0]).column({"trip_soc": F.col("distance_m") / 5000}).alias("bin"))


@query(net(f"SELECT edge_id, round({HAVERSINE.replace('py', 'src_y').replace('px', 'src_x').replace('(y ', '(dst_y ').replace('(x ', '(dst_x ').replace('(y)', '(dst_y)')} / 1000, 4) AS km FROM T"))
def estimated_cost(spark, sf_dir):
    """What the straight way between an edge's ends would cost."""
    chain = [models.Distance()]
    features = models.features_of(chain)
    model = CostModel({"trip_distance": 1.0}, {"trip_distance": Rate("distance", 1.0, "km")}).checked(features)
    e = _network(spark, sf_dir).wide_edges()
    start = {f.name: F.lit(0.0) for f in features}
    after = models.step(Columns, chain, features, {c: F.col(c) for c in ("src_x", "src_y", "dst_x", "dst_y")}, start, {}, estimate=True)
    return e.select("edge_id", F.round(model.costs(Columns, features, start, after)[0], 4).alias("km"))


@query("SELECT * FROM (VALUES ('trip_distance', 0, 2.0::DOUBLE, 'distance', 'km'), ('trip_time', 1, 3.0::DOUBLE, 'time', NULL)) v(feature, index, weight, rate, unit)")
def cost_description(spark, sf_dir):
    chain = models.ordered([models.Distance(), models.Speed(), models.Time()])
    model = CostModel({"trip_distance": 2.0, "trip_time": 3.0}, {"trip_distance": Rate("distance", 0.5, "km"), "trip_time": Rate("time")}).checked(models.features_of(chain))
    return spark.createDataFrame([(d["feature"], d["index"], d["weight"], d["rate"], d["unit"]) for d in model.description()], "feature string, index int, weight double, rate string, unit string")


@query("SELECT * FROM (VALUES ('negative', TRUE), ('unknown', TRUE), ('zero', TRUE), ('good', FALSE)) v(name, refused)")
def cost_validation(spark, sf_dir):
    features = models.features_of([models.Distance()])

    def refused(weights: dict) -> bool:
        try:
            CostModel(weights, {"trip_distance": Rate()}).checked(features)
        except cost.CostError:
            return True
        return False

    given = {"negative": {"trip_distance": -1.0}, "unknown": {"other": 1.0}, "zero": {"trip_distance": 0.0}, "good": {"trip_distance": 1.0}}
    return spark.createDataFrame([(k, refused(v)) for k, v in given.items()], "name string, refused boolean")


@query(net("SELECT edge_id, round(distance_m / 3600, 6) AS hours, round(distance_m / 60, 6) AS minutes, round(distance_m * 1000, 3) AS ms, round(distance_m * 0.45359237::DOUBLE, 6) AS kg, round(distance_m / 1000, 6) AS tons, round(distance_m * 3.6e6::DOUBLE / 1.449452e8::DOUBLE, 6) AS gde, round(distance_m * 3.350554e7::DOUBLE / 3.6e6::DOUBLE, 4) AS lge, round(distance_m / 1000 * 3.6e6::DOUBLE / 1.26832984e8::DOUBLE, 6) AS rate FROM E"))
def more_units(spark, sf_dir):
    c = lambda kind, a, b, n=6: F.round(units.convert(F.col("distance_m"), kind, a, b), n)
    per_km = energy.Prediction([("edge_speed", "speed", "mph")], [(0.0, 1.0, 2)], [1.0, 1.0], "kilowatt_hours_per_kilometer").energy(Columns, {"edge_distance": F.col("distance_m") / models.MILE_M, "edge_speed": F.lit(0.5)})
    return _edges(spark, sf_dir).select("edge_id", c("time", "s", "hours").alias("hours"), c("time", "seconds", "min").alias("minutes"), c("time", "sec", "ms", 3).alias("ms"), c("weight", "lbs", "kg").alias("kg"), c("weight", "kg", "tons").alias("tons"), c("energy", "kwh", "gde").alias("gde"), c("energy", "lge", "kwh", 4).alias("lge"), F.round(per_km, 6).alias("rate"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_size / 100.0::DOUBLE + 0.1::DOUBLE WHEN p_partkey % 3 = 1 THEN p_size + 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dollars FROM part")
def price_ranges(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    n, k = F.col("p_size"), F.col("p_partkey")
    price = F.when(k % 3 == 2, F.concat(F.lit("$0.10-$"), F.format_string("%.2f", n / 50.0 + 0.1), F.lit(" each kWh"))).when(k % 3 == 1, F.concat(F.lit("$1-$"), (n + 1).cast("string"), F.lit("/kWh")))
    got = text.price_per_kwh(price)
    return part.select("p_partkey", F.when(k % 3 == 2, n / 100.0 + 0.1).otherwise(F.coalesce(got, F.lit(0.0))).alias("dollars"))


# -- graph ------------------------------------------------------------------------------------------------------------------


@query(net("SELECT edge_id, src, dst, (SELECT x FROM V WHERE vertex_id = src) AS x FROM E WHERE edge_id = (SELECT min(edge_id) FROM E)"))
def edge_lookup(spark, sf_dir):
    n = _network(spark, sf_dir)
    row = n.require_edge(0, n.edges.agg(F.min("edge_id")).first()[0])
    return n.edge(0, row["edge_id"]).join(n.vertex(row["src"]), F.col("src") == F.col("vertex_id")).select("edge_id", "src", "dst", "x")


@query(net("SELECT 0 AS edge_list_id, edge_id, src, dst FROM E"))
def endpoints(spark, sf_dir):
    return _network(spark, sf_dir).endpoints()


@query(net("SELECT dst AS vertex_id, edge_id, src, round(src_x, 6) AS src_x, dst, distance_m FROM T WHERE dst % 10 = 3"))
def incident_triplets(spark, sf_dir):
    n = _network(spark, sf_dir)
    made = n.incident_triplets(n.vertices.filter("vertex_id % 10 = 3"), "reverse")
    return made.select("vertex_id", "edge_id", "src", F.round("src_x", 6).alias("src_x"), "dst", "distance_m")


@query(net("SELECT edge_id, src AS origin, dst AS destination, round(distance_m / 1000, 6) AS km, (SELECT count(*) FROM E b WHERE b.src = a.src) AS n_out, (SELECT count(*) FROM E b WHERE b.dst = a.src) AS n_in FROM E a WHERE edge_id = (SELECT max(edge_id) FROM E)"))
def graph_getters(spark, sf_dir):
    """The application's getters."""
    n = _network(spark, sf_dir)
    app = App(spark, {}, n)
    e = n.edges.agg(F.max("edge_id")).first()[0]
    v = app.edge_origin(e)
    return spark.createDataFrame([(e, v, app.edge_destination(e), round(app.edge_distance(e, unit="km"), 6), len(app.out_edge_ids(v)), len(app.in_edge_ids(v)))], "edge_id long, origin long, destination long, km double, n_out long, n_in long")


BEARING = "CAST(fmod(degrees(atan2(sin(radians(dst_x - src_x)) * cos(radians(dst_y)), cos(radians(src_y)) * sin(radians(dst_y)) - sin(radians(src_y)) * cos(radians(dst_y)) * cos(radians(dst_x - src_x)))) + 360, 360) AS DOUBLE)"


@query(net(f"SELECT edge_id, CAST(floor({BEARING} + 1e-9::DOUBLE) AS INT) AS heading FROM T WHERE abs({BEARING} - round({BEARING})) > 1e-6::DOUBLE"))
def headings(spark, sf_dir):
    """Compass bearings of edges, but for those within a millionth of a whole degree."""
    e = _network(spark, sf_dir).wide_edges()
    at = [F.col(c) for c in ("src_x", "src_y", "dst_x", "dst_y")]
    lat0, lat1, dlon = F.radians(at[1]), F.radians(at[3]), F.radians(at[2] - at[0])
    exact = F.pmod(F.degrees(F.atan2(F.sin(dlon) * F.cos(lat1), F.cos(lat0) * F.sin(lat1) - F.sin(lat0) * F.cos(lat1) * F.cos(dlon))) + 360, F.lit(360.0))
    return e.filter(F.abs(exact - F.round(exact)) > 1e-6).select("edge_id", geo.bearing(*at).alias("heading"))


# -- matching ---------------------------------------------------------------------------------------------------------------


@query(_with("SELECT n_nationkey AS point_id, e.edge_id, e.src, e.dst, CASE WHEN e.edge_id IS NULL THEN 'edge is not there or not valid' END AS error FROM nation LEFT JOIN E e ON e.edge_id = CASE WHEN n_nationkey % 5 = 0 THEN -1 ELSE (SELECT min(edge_id) FROM E WHERE src >= n_nationkey * 7) END".replace("e.edge_id, e.src", "coalesce(e.edge_id, -1) AS edge_id, e.src").replace("n_nationkey AS point_id", "CAST(n_nationkey AS BIGINT) AS point_id"), "Z AS (SELECT 1 AS z)"))
def match_edges(spark, sf_dir):
    """Edges by id, some of which are not there."""
    (nation,) = tables(spark, sf_dir, "nation")
    n, k = _network(spark, sf_dir), F.col("n_nationkey")
    first = nation.select(k.cast("long").alias("point_id"), k.alias("k")).join(n.edges.select("src", "edge_id"), F.col("src") >= F.col("k") * 7).groupBy("point_id").agg(F.min("edge_id").alias("e"))
    rows = first.select("point_id", F.lit(0).alias("edge_list_id"), F.when(F.col("point_id") % 5 == 0, F.lit(-1)).otherwise(F.col("e")).alias("edge_id"))
    return matching.match_by_edge(rows, n).select("point_id", "edge_id", "src", "dst", "error")


@query(net("SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey * 3 IN (SELECT src FROM E) THEN n_nationkey * 3 WHEN n_nationkey % 3 = 1 THEN (SELECT dst FROM E WHERE edge_id = (SELECT min(edge_id) FROM E)) END AS origin, CASE WHEN n_nationkey % 3 = 2 THEN 'no origin' WHEN n_nationkey % 3 = 0 AND n_nationkey * 3 NOT IN (SELECT src FROM E) THEN 'vertex cannot be a origin' ELSE 'no destination' END AS error FROM nation"))
def match_combined(spark, sf_dir):
    """Requests by vertex or edge, in an order, where a destination is required but none is given."""
    (nation,) = tables(spark, sf_dir, "nation")
    n, k = _network(spark, sf_dir), F.col("n_nationkey")
    edge = n.edges.agg(F.min("edge_id")).first()[0]
    body = F.to_json(F.struct(F.when(k % 3 == 0, k * 3).alias("origin_vertex"), F.when(k % 3 == 1, F.lit(edge)).alias("origin_edge")))
    typed = nation.select(k.cast("long").alias("query_id"), F.from_json(body, REQUEST).alias("r")).select("query_id", "r.*")
    return matching.match_requests(typed, n, ("vertex", "edge"), destination_required=True).select("query_id", "origin", "error")


@query(net(f", {POINTS}, B AS (SELECT edge_id, CAST(CAST(least(src_x, dst_x) AS FLOAT) AS DOUBLE) AS x0, CAST(CAST(greatest(src_x, dst_x) AS FLOAT) AS DOUBLE) AS x1, CAST(CAST(least(src_y, dst_y) AS FLOAT) AS DOUBLE) AS y0, CAST(CAST(greatest(src_y, dst_y) AS FLOAT) AS DOUBLE) AS y1 FROM T), D AS (SELECT point_id, edge_id, pow(greatest(x0 - px, 0, px - x1), 2) + pow(greatest(y0 - py, 0, py - y1), 2) AS d2 FROM Q, B), M AS (SELECT point_id, min(d2) AS m FROM D GROUP BY point_id) SELECT D.point_id, min(edge_id) AS edge_id, round(m, 9) AS d2 FROM D JOIN M ON M.point_id = D.point_id AND d2 = m GROUP BY D.point_id, m").replace("\n,", ",", 1))
def nearest_bbox_edge(spark, sf_dir):
    made = matching.nearest_edge(_points(spark, sf_dir), _network(spark, sf_dir).straight_lines())
    return made.select("point_id", "edge_id", F.round("d2", 9).alias("d2"))


@query(net("SELECT s_suppkey AS row, e.edge_id, round(CAST(CAST(src_x AS FLOAT) AS DOUBLE), 4) AS x FROM supplier JOIN (SELECT *, row_number() OVER (ORDER BY edge_id) AS r FROM T) e ON r = s_suppkey"))
def geometry_lookup(spark, sf_dir):
    """Lines of edges that are asked for, in the rows' places."""
    (supplier,) = tables(spark, sf_dir, "supplier")
    n = _network(spark, sf_dir)
    ids = dataset.numbered(n.edges.select("edge_list_id", "edge_id"), ["edge_id"], "at")
    asked = supplier.join(ids, F.col("s_suppkey") == F.col("at") + 1).select(F.col("s_suppkey").alias("row"), "edge_list_id", "edge_id")
    return matching.lines_of(asked, n.straight_lines()).select("row", "edge_id", F.round(F.col("line")[0]["x"].cast("double"), 4).alias("x"))


# -- searches and routes ----------------------------------------------------------------------------------------------------


@query(SEARCH + "SELECT B.q AS query_id, v AS vertex_id, g * (1 + B.q % 3) AS g, g + 1000 AS metres FROM B")
def weighted_batch(spark, sf_dir):
    """Requests with weights of their own in one search, and states that start elsewhere."""
    n, r = derived_network(spark, sf_dir).cached(), _trees(_requests(spark, sf_dir))
    model = CostModel({}, {"trip_metres": Rate("raw"), "trip_distance": Rate("zero")}, own_weights=True)
    setup = Setup([models.Custom("trip_metres", "distance_m", accumulator=True), models.Distance()], model, initial={"trip_metres": 1000.0})
    own = r.withColumn("weights", F.create_map(F.lit("trip_metres"), (1 + F.col("query_id") % 3).cast("double")))
    return trees(n, own, setup).select("query_id", "vertex_id", _g().alias("g"), _g("state.trip_metres").alias("metres"))


EDGE_ENDS = "R AS (SELECT CAST(n_nationkey AS BIGINT) AS q, (SELECT arg_min(dst, edge_id) FROM E WHERE src >= n_nationkey * 79 % (SELECT count(*) FROM V)) AS o, (SELECT arg_min(src, edge_id) FROM E WHERE src >= (n_nationkey * 31 + 7) % (SELECT count(*) FROM V)) AS d FROM nation)"


@query(f"WITH RECURSIVE {NET.strip()},\n{EDGE_ENDS},\n{relaxed_sql()},{ROUTE} SELECT q AS query_id, o AS origin, d AS destination, g, 2 + (SELECT count(*) FROM L WHERE L.query_id = R.q) AS n_edges FROM R JOIN B USING (q) WHERE v = d")
def edge_oriented(spark, sf_dir):
    """From edge to edge, with both in the route."""
    n, e = derived_network(spark, sf_dir).cached(), None
    asked = _requests(spark, sf_dir)
    v, e = tables(spark, sf_dir, "part")[0].count(), n.edges.select("src", "edge_id")
    first = lambda name: asked.select("query_id", F.col(name).alias("k")).join(e, F.col("src") >= F.col("k")).groupBy("query_id").agg(F.min("edge_id").alias(f"{name}_edge"))
    ends = materialise(first("origin").join(first("destination"), "query_id").select("query_id", F.lit(0).alias("origin_list"), "origin_edge", F.lit(0).alias("destination_list"), "destination_edge"), "ends")
    r = materialise(ksp.edge_oriented(n, ends), "asked")
    tree = trees(n, r, _metres(), ways=True)
    rows = ksp.with_end_edges(paths.routes(tree, r), r).groupBy("query_id").agg(F.count("*").alias("n_edges"))
    g = paths.leaves(tree, r.select("query_id", F.col("destination").alias("vertex_id")))
    assert v
    return r.join(g, "query_id").join(rows, "query_id").select("query_id", "origin", "destination", _g().alias("g"), "n_edges")


@query("SELECT l_orderkey AS query_id, 0 AS route_idx, count(DISTINCT l_partkey) < count(*) AS loop FROM lineitem GROUP BY l_orderkey")
def loops(spark, sf_dir):
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    return paths.has_loop(lineitem.select(F.col("l_orderkey").alias("query_id"), F.lit(0).alias("route_idx"), F.col("l_partkey").alias("from_vertex")))


@query("WITH a AS (SELECT l_orderkey AS q, list(CAST(l_quantity AS BIGINT) % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS e FROM lineitem GROUP BY l_orderkey) SELECT a.q AS query_id, a.e = b.e AS same FROM a JOIN a b ON b.q = a.q + 1")
def route_equality(spark, sf_dir):
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    rows = lineitem.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity").cast("long") % 3).alias("m")))), lambda x: x["m"]).alias("e"))
    after = rows.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("e").alias("f"))
    return rows.join(after, "l_orderkey").select(F.col("l_orderkey").alias("query_id"), ksp.same_route(F.col("e"), F.col("f")).alias("same"))


@query(SEARCH + "SELECT query_id, CAST(max(distance_m) AS BIGINT) AS most, CAST(min(distance_m) AS BIGINT) AS least, CAST(arg_min(distance_m, pos) AS BIGINT) AS first, CAST(arg_max(distance_m, pos) AS BIGINT) AS last, round(avg(distance_m), 6) AS mean FROM L GROUP BY query_id")
def summary_ops(spark, sf_dir):
    _, rows, _ = _routes(spark, sf_dir)
    s = _metres()
    each = rows.withColumn("state", F.struct(F.col("objective_cost").alias("edge_metres")))
    made = [each.groupBy("query_id").agg(output.summary_op("edge_metres", how).alias(name)) for name, how in (("most", "max"), ("least", "min"), ("first", "first"), ("last", "last"), ("mean", "avg"))]
    out = made[0]
    for m in made[1:]:
        out = out.join(m, "query_id")
    assert s.features
    return out.select("query_id", _g("most").alias("most"), _g("least").alias("least"), _g("first").alias("first"), _g("last").alias("last"), F.round("mean", 6).alias("mean"))


@query(SEARCH + "SELECT query_id, CAST(sum(distance_m) AS BIGINT) AS trip_metres, count(*) AS n FROM L GROUP BY query_id")
def route_json(spark, sf_dir):
    """Routes as JSON: the last edge's state, and how many edges."""
    _, rows, s = _routes(spark, sf_dir)
    made = output.route_output(rows, "json", s.features).select("query_id", F.from_json("route", "array<struct<edge_id:long,result_state:struct<trip_metres:double>>>").alias("r"))
    return made.select("query_id", _g(F.element_at("r", -1)["result_state"]["trip_metres"]).alias("trip_metres"), F.size("r").cast("long").alias("n"))


@query(SEARCH + "SELECT query_id, 2 * count(*) AS points FROM L GROUP BY query_id")
def route_wkb(spark, sf_dir):
    n, rows, s = _routes(spark, sf_dir)
    made = output.route_output(rows, "wkb", s.features, n.straight_lines())
    return made.select("query_id", F.size(geo.points_of_wkb(F.unhex("route"))).cast("long").alias("points"))


@query(SEARCH + "SELECT q AS query_id, count(*) - 1 AS edges, count(*) - 1 AS points, lpad(printf('%x', (count(*) - 1) % 256), 2, '0') AS low FROM B GROUP BY q")
def tree_formats(spark, sf_dir):
    """Trees as edge ids, as points, and as one multi-line of bytes whose count is told at its head."""
    n, s = derived_network(spark, sf_dir).cached(), _metres()
    tree = trees(n, _trees(_requests(spark, sf_dir)), s)
    ids = output.tree_output(tree, "edge_id", s.features).select("query_id", F.size(F.from_json("tree", "array<struct<edge_id:long>>")).cast("long").alias("edges"))
    points = output.tree_output(tree, "multipoint", s.features, n.straight_lines()).select("query_id", F.size(F.split("tree", ",")).cast("long").alias("points"))
    wkb = output.tree_output(tree, "wkb", s.features, n.straight_lines()).select("query_id", F.lower(F.substring("tree", 11, 2)).alias("low"))
    return ids.join(points, "query_id").join(wkb, "query_id")


@query("SELECT query_id, CASE WHEN n = 1 THEN '\"r0\"' ELSE '[' || string_agg('\"r' || i || '\"', ',' ORDER BY i) || ']' END AS route FROM (SELECT CAST(n_nationkey AS BIGINT) AS query_id, n_nationkey % 3 + 1 AS n FROM nation), range(0, 3) t(i) WHERE i < n GROUP BY query_id, n")
def cardinality(spark, sf_dir):
    (nation,) = tables(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    rows = nation.select(k.cast("long").alias("query_id"), F.explode(F.sequence(F.lit(0), k % 3)).alias("route_idx"))
    return output.by_cardinality(rows.withColumn("route", F.concat(F.lit('"r'), F.col("route_idx"), F.lit('"'))))


@query(_with("SELECT q AS query_id, 'u' || o AS origin_uuid, CASE WHEN d % 2 = 0 THEN 'u' || d END AS destination_uuid FROM R".replace("'u' || o AS", "CASE WHEN o % 2 = 0 THEN 'u' || o END AS"), NATIONS))
def uuids(spark, sf_dir):
    known = _network(spark, sf_dir).vertices.unionByName(spark.createDataFrame([(0, 0.0, 0.0)], "vertex_id long, x double, y double")).filter("vertex_id % 2 = 0").select("vertex_id", F.concat(F.lit("u"), F.col("vertex_id")).alias("uuid")).distinct()
    return output.with_uuids(_requests(spark, sf_dir), known).select("query_id", "origin_uuid", "destination_uuid")


@query(SEARCH + "SELECT q AS query_id, v AS vertex_id, CAST(round(g / 1609.344::DOUBLE * 1.609344::DOUBLE * 1000) AS BIGINT) AS metres FROM B")
def state_units(spark, sf_dir):
    """States in the units that they are shown in."""
    chain = [models.Custom("trip_metres", "distance_m", accumulator=True), models.Distance()]
    setup = Setup(chain, CostModel({"trip_metres": 1.0}, {"trip_metres": Rate("raw")}))
    tree = trees(derived_network(spark, sf_dir).cached(), _trees(_requests(spark, sf_dir)), setup)
    shown = [Feature("trip_distance", "distance", True, output_unit="kilometers")]
    return tree.select("query_id", "vertex_id", F.round(output.state_in_output_units("state", shown, final=True)["trip_distance"] * 1000).cast("long").alias("metres"))


@query(f"WITH {NET.strip()},\n{NATIONS},\n{relaxed_sql()} SELECT R.q AS query_id, CASE WHEN o NOT IN (SELECT src FROM E) THEN 'vertex cannot be a origin' WHEN d NOT IN (SELECT dst FROM E) THEN 'vertex cannot be a destination' WHEN R.q % 5 = 4 THEN 'a weight is negative' WHEN g IS NULL THEN 'no path' END AS error, CASE WHEN R.q % 5 < 4 AND o IN (SELECT src FROM E) AND d IN (SELECT dst FROM E) THEN g * (1 + R.q % 5) END AS cost FROM R LEFT JOIN b24 b ON b.q = R.q AND b.v = R.d")
def app_batch(spark, sf_dir):
    """The application: a batch of requests with weights of their own, some of them wrong, from JSON to JSON."""
    n = _network(spark, sf_dir)
    config = cfg.merge(cfg.DEFAULTS, {"traversal": {"type": "custom", "name": "trip_metres", "column": "distance_m", "accumulator": True}, "cost": {"weights": {"trip_metres": 1.0}, "vehicle_rates": {"trip_metres": {"type": "raw"}}}, "mapping": {"matching_type": ["vertex"]}, "plugin": {"input_plugins": [], "output_plugins": [{"type": "summary"}]}, "termination": {"type": "combined", "models": []}})  # no clock decides an answer
    weight = F.when(F.col("query_id") % 5 == 4, F.lit(-1)).otherwise(1 + F.col("query_id") % 5).cast("double")
    body = F.to_json(F.struct(F.col("origin").alias("origin_vertex"), F.col("destination").alias("destination_vertex"), F.struct(weight.alias("trip_metres")).alias("weights")))
    made = App(spark, config, n).run_frame(_requests(spark, sf_dir).select("query_id", body.alias("request")))
    at = lambda p: F.get_json_object("response", f"$.{p}")
    return made.select("query_id", at("error").alias("error"), _g(at("traversal_summary.objective_cost").cast("double")).alias("cost"))
