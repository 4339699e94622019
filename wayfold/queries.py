"""Queries for the route engine's operators over the driver's tables, with DuckDB SQL for the same rows.

The network is derived from part and lineitem; requests come from whole small tables (one for each nation or supplier).
Searches that SQL checks cost whole metres, so that sums are exact and ties are decided by edge id on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo, text, units
from wayfold.operators import cost, energy, graph, matching, models, output, shaping
from wayfold.operators.constraints import RoadClass, VehicleRestriction, normalised_restrictions
from wayfold.operators.cost import CostModel, Rate
from wayfold.operators.models import Columns
from wayfold.plans import ksp, paths
from wayfold.plans.scratch import materialise
from wayfold.plans.search import Limits, Setup, kernel, least_costs, trees
from wayfold.sources import dataset, sinks
from wayfold.sources.derived import derived_edges, derived_network, derived_vertices, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NET = """
V AS (SELECT p_partkey AS vertex_id, -105 + CAST(p_partkey * 7919 % 1000 AS DOUBLE) / 1000 AS x, 39 + CAST(p_partkey * 104729 % 1000 AS DOUBLE) / 1000 AS y FROM part),
legs AS (SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER w AS dst, row_number() OVER w AS nr, CAST(floor(l_quantity * 100) AS BIGINT) AS metres, CAST(round(l_tax * 100) AS INT) AS tax, CAST(round(l_discount * 100) AS INT) AS discount, l_returnflag
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
E AS (SELECT 0 AS edge_list_id, src * 2147483648 + dst AS edge_id, src, dst, CAST(min(metres) AS DOUBLE) AS distance_m, CAST(30 + 10 * min(tax) AS DOUBLE) AS speed_kph, CAST(min(discount) - 5 AS DOUBLE) / 100 AS grade,
  min(l_returnflag) AS road_class, CAST(src * 37 % 360 AS INT) AS arrival_heading, CAST(dst * 53 % 360 AS INT) AS departure_heading
  FROM legs WHERE dst IS NOT NULL AND src <> dst AND src IN (SELECT vertex_id FROM V) AND dst IN (SELECT vertex_id FROM V) GROUP BY src, dst),
T AS (SELECT e.*, a.x AS src_x, a.y AS src_y, b.x AS dst_x, b.y AS dst_y FROM E e JOIN V a ON a.vertex_id = src JOIN V b ON b.vertex_id = dst)"""
NATIONS = "R AS (SELECT CAST(n_nationkey AS BIGINT) AS q, n_nationkey * 79 % (SELECT count(*) FROM V) AS o, (n_nationkey * 31 + 7) % (SELECT count(*) FROM V) AS d FROM nation)"
ROUNDS = 24


def relaxed_sql(near: str = "src", far: str = "dst", rounds: int = ROUNDS, start: str = "o") -> str:
    chain = [f"b0 AS MATERIALIZED (SELECT q, {start} AS v, CAST(0 AS BIGINT) AS g FROM R)"]
    for i in range(1, rounds + 1):
        chain.append(f"b{i} AS MATERIALIZED (SELECT q, v, min(g) AS g FROM (SELECT * FROM b{i - 1} UNION ALL SELECT q, {far}, g + CAST(distance_m AS BIGINT) FROM b{i - 1} JOIN E ON {near} = v) GROUP BY q, v)")
    return ",\n".join(chain)


ROUTE = f"""
B AS MATERIALIZED (SELECT * FROM b{ROUNDS}),
P AS MATERIALIZED (SELECT c.q, c.v, min(e.edge_id) AS edge_id FROM B c JOIN E e ON e.dst = c.v JOIN B p ON p.q = c.q AND p.v = e.src AND p.g + CAST(e.distance_m AS BIGINT) = c.g JOIN R ON R.q = c.q AND c.v <> R.o GROUP BY c.q, c.v),
W AS (SELECT q, d AS v, 0 AS back FROM R UNION ALL SELECT W.q, e.src, back + 1 FROM W JOIN P ON P.q = W.q AND P.v = W.v JOIN E e ON e.edge_id = P.edge_id),
L AS (SELECT W.q AS query_id, row_number() OVER (PARTITION BY W.q ORDER BY back DESC) - 1 AS pos, back, P.edge_id, E.* EXCLUDE (edge_id) FROM W JOIN P ON P.q = W.q AND P.v = W.v JOIN E ON E.edge_id = P.edge_id)"""
SEARCH = f"WITH RECURSIVE {NET.strip()},\n{NATIONS},\n{relaxed_sql()},{ROUTE}"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def net(sql: str) -> str:
    return f"WITH {NET.strip()}\n{sql}"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lineitem = tables(spark, sf_dir, "part", "lineitem")
    known = part.select(F.col("p_partkey").alias("k"))
    e = derived_edges(lineitem)
    return e.join(known, e["src"] == known["k"], "left_semi").join(known, e["dst"] == known["k"], "left_semi")


def _network(spark: SparkSession, sf_dir: str) -> graph.Network:
    return graph.Network(derived_vertices(tables(spark, sf_dir, "part")[0]), _edges(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, part = tables(spark, sf_dir, "nation", "part")
    v = part.agg(F.count("*").alias("v"))
    key = F.col("n_nationkey")
    return nation.join(F.broadcast(v)).select(key.cast("long").alias("query_id"), (key * 79 % F.col("v")).alias("origin"), ((key * 31 + 7) % F.col("v")).alias("destination"))


def _metres(**more) -> Setup:
    return Setup([models.Custom("trip_metres", "distance_m", accumulator=True), models.Distance()], CostModel({"trip_metres": 1.0}, {"trip_metres": Rate("raw")}), **more)


def _trees(requests: DataFrame) -> DataFrame:
    return requests.withColumn("destination", F.lit(None).cast("long"))


def _g(column: str = "g"):
    return F.round(column, 3).cast("long")


# -- graph ------------------------------------------------------------------------------------------------------------------


@query(net("SELECT edge_list_id, edge_id, src, round(src_x, 6) AS src_x, round(src_y, 6) AS src_y, dst, round(dst_x, 6) AS dst_x, round(dst_y, 6) AS dst_y, distance_m FROM T"))
def edge_triplets(spark, sf_dir):
    t = _network(spark, sf_dir).triplets()
    return t.select("edge_list_id", "edge_id", "src", F.round("src_x", 6).alias("src_x"), F.round("src_y", 6).alias("src_y"), "dst", F.round("dst_x", 6).alias("dst_x"), F.round("dst_y", 6).alias("dst_y"), "distance_m")


@query(net("SELECT src AS vertex_id, edge_list_id, edge_id, dst AS adjacent, distance_m FROM E"))
def out_edges(spark, sf_dir):
    n = _network(spark, sf_dir)
    return n.out_edges(n.vertex_ids())


@query(net("SELECT dst AS vertex_id, edge_list_id, edge_id, src AS adjacent, distance_m FROM E"))
def in_edges(spark, sf_dir):
    n = _network(spark, sf_dir)
    return n.in_edges(n.vertex_ids())


@query(net("SELECT vertex_id, (SELECT count(*) FROM E WHERE src = vertex_id) AS out_degree, (SELECT count(*) FROM E WHERE dst = vertex_id) AS in_degree FROM V"))
def degrees(spark, sf_dir):
    return _network(spark, sf_dir).degrees()


@query(net("SELECT edge_list_id, edge_id, side, vertex_id FROM (SELECT edge_list_id, edge_id, 'src' AS side, src AS vertex_id FROM E UNION ALL SELECT edge_list_id, edge_id, 'dst', dst FROM E) WHERE vertex_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)"))
def bad_refs(spark, sf_dir):
    part = tables(spark, sf_dir, "part")[0]
    return graph.Network(derived_vertices(part.filter("p_size > 1")), _edges(spark, sf_dir)).bad_references()


@query(net("SELECT (SELECT count(*) FROM V) AS n_vertices, (SELECT count(*) FROM E) AS n_edges, (SELECT count(DISTINCT edge_list_id) FROM E) AS n_edge_lists"))
def network_counts(spark, sf_dir):
    return _network(spark, sf_dir).counts()


REACH = net("""
, C AS (SELECT src AS a, dst AS b FROM E UNION SELECT C.a, E.dst FROM C JOIN E ON E.src = C.b),
M AS (SELECT vertex_id, least(vertex_id, coalesce((SELECT min(c1.b) FROM C c1 JOIN C c2 ON c2.a = c1.b AND c2.b = c1.a WHERE c1.a = vertex_id), vertex_id)) AS component FROM V)
""").replace("WITH ", "WITH RECURSIVE ", 1).replace("\n\n,", ",\n")


@query(REACH + "SELECT vertex_id, component FROM M")
def scc(spark, sf_dir):
    return graph.strong_components(_network(spark, sf_dir))


@query(REACH + "SELECT vertex_id, component FROM M WHERE component = (SELECT component FROM M GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)")
def largest_scc(spark, sf_dir):
    return graph.largest_component(graph.strong_components(_network(spark, sf_dir)))


# -- models on edges --------------------------------------------------------------------------------------------------------


def _stepped(spark, sf_dir, chain: list, q: dict | None = None, before: dict | None = None) -> tuple[DataFrame, dict]:
    e = _network(spark, sf_dir).wide_edges()
    chain = models.ordered(chain)
    features = models.features_of(chain)
    start = {f.name: F.lit(f.initial) for f in features} | (before or {})
    return e, models.step(Columns, chain, features, {c: F.col(c) for c in e.columns}, start, q or {})


@query(net("SELECT edge_id, round(speed_kph * (1000.0::DOUBLE / 3600 / (1609.344::DOUBLE / 3600)), 6) AS edge_speed FROM E"))
def speed_join(spark, sf_dir):
    e, s = _stepped(spark, sf_dir, [models.Speed()])
    return e.select("edge_id", F.round(s["edge_speed"], 6).alias("edge_speed"))


@query(net("SELECT edge_id, round(least(speed_kph, 50) / 1.609344::DOUBLE, 6) AS edge_speed FROM E"))
def speed_limit(spark, sf_dir):
    e, s = _stepped(spark, sf_dir, [models.Speed()], {"speed_limit": 50.0, "speed_limit_unit": "kph"})
    return e.select("edge_id", F.round(s["edge_speed"], 6).alias("edge_speed"))


@query(net("SELECT round(max(speed_kph) / 1.609344::DOUBLE, 6) AS fastest_mph, count(*) AS n FROM E"))
def max_speed(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return e.agg(F.round(F.lit(models.fastest_mph(e)), 6).alias("fastest_mph"), F.count("*").alias("n"))


@query(net("SELECT edge_id, round(distance_m / 1609.344::DOUBLE, 6) AS edge_distance, round(distance_m / 1000 / speed_kph * 60, 6) AS edge_time FROM E"))
def edge_time(spark, sf_dir):
    e, s = _stepped(spark, sf_dir, [models.Time(), models.Speed(), models.Distance()])
    return e.select("edge_id", F.round(s["edge_distance"], 6).alias("edge_distance"), F.round(s["edge_time"], 6).alias("edge_time"))


@query(net("SELECT edge_id, round(greatest(grade, 0) * distance_m / 1609.344::DOUBLE, 6) + 0.0 AS gain, round(least(grade, 0) * distance_m / 1609.344::DOUBLE, 6) + 0.0 AS loss FROM E"))
def grade_elevation(spark, sf_dir):
    e, s = _stepped(spark, sf_dir, [models.Elevation(), models.Grade(), models.Distance()])
    return e.select("edge_id", (F.round(s["trip_elevation_gain"], 6) + 0.0).alias("gain"), (F.round(s["trip_elevation_loss"], 6) + 0.0).alias("loss"))


@query(net("SELECT edge_id, round((70::DOUBLE - 32) * 5 / 9 + 273.15::DOUBLE, 6) AS kelvin FROM E"))
def ambient_temperature(spark, sf_dir):
    e, s = _stepped(spark, sf_dir, [models.Temperature(70.0)])
    return e.select("edge_id", F.round(s["ambient_temperature"], 6).alias("kelvin"))


TURN = "CASE WHEN arrival_heading - departure_heading > 180 THEN arrival_heading - departure_heading - 360 WHEN arrival_heading - departure_heading < -180 THEN arrival_heading - departure_heading + 360 ELSE arrival_heading - departure_heading END"
CLASS = "CASE WHEN abs(angle) <= 19 THEN 'no_turn' WHEN abs(angle) <= 44 THEN 'slight_' || side WHEN abs(angle) <= 134 THEN side WHEN abs(angle) <= 159 THEN 'sharp_' || side ELSE 'u_turn' END"
DELAYS = {"no_turn": 0.0, "slight_left": 2.0, "slight_right": 1.0, "left": 6.0, "right": 3.0, "sharp_left": 8.0, "sharp_right": 5.0, "u_turn": 12.0}


def _angle() -> F.Column:
    return models.bearing_change(Columns, F.col("departure_heading"), F.col("arrival_heading"))


@query(net(f"SELECT edge_id, CAST({TURN} AS INT) AS angle FROM E"))
def bearing_change(spark, sf_dir):
    return _edges(spark, sf_dir).select("edge_id", _angle().cast("int").alias("angle"))


@query(net(f", A AS (SELECT edge_id, {TURN} AS angle FROM E), S AS (SELECT *, CASE WHEN angle < 0 THEN 'left' ELSE 'right' END AS side FROM A) SELECT edge_id, {CLASS} AS turn FROM S").replace("\n,", ",", 1))
def turn_class(spark, sf_dir):
    return _edges(spark, sf_dir).select("edge_id", models.turn_class(Columns, _angle()).alias("turn"))


@query(net(f", A AS (SELECT edge_id, {TURN} AS angle FROM E), S AS (SELECT *, CASE WHEN angle < 0 THEN 'left' ELSE 'right' END AS side FROM A), D(turn, seconds) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in DELAYS.items())}), Z AS (SELECT edge_id, {CLASS} AS turn FROM S) SELECT edge_id, round(CAST(seconds AS DOUBLE) / 60, 6) AS delay FROM Z JOIN D USING (turn)").replace("\n,", ",", 1))
def turn_delay(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("prev_departure_heading", F.col("departure_heading"))
    m = models.TurnDelay(DELAYS)
    s = m.traverse(Columns, {c: F.col(c) for c in e.columns}, {"edge_time": F.lit(0.0), "trip_time": F.lit(0.0)}, {})
    return e.select("edge_id", F.round(s["edge_turn_delay"], 6).alias("delay"))


@query(net("SELECT edge_id, distance_m AS metres, round(speed_kph + 1, 6) AS raised, CAST(road_class = 'R' AS DOUBLE) AS open FROM E"))
def custom_model(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("is_r", F.col("road_class") == "R")
    chain = [models.Custom("metres", "distance_m"), models.Custom("raised", "speed_kph", accumulator=True), models.Custom("open", "is_r", boolean=True, accumulator=True, initial=1.0)]
    features = models.features_of(chain)
    start = {"metres": F.lit(5.0), "raised": F.lit(1.0), "open": F.lit(1.0)}
    s = models.step(Columns, chain, features, {c: F.col(c) for c in e.columns}, start, {})
    return e.select("edge_id", s["metres"].alias("metres"), F.round(s["raised"], 6).alias("raised"), s["open"].alias("open"))


@query(net("SELECT edge_id, round(2 * 6371000 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(dst_y - src_y) / 2), 2) + cos(radians(src_y)) * cos(radians(dst_y)) * pow(sin(radians(dst_x - src_x) / 2), 2)))), 3) AS metres FROM T"))
def haversine(spark, sf_dir):
    e = _network(spark, sf_dir).wide_edges()
    return e.select("edge_id", F.round(geo.haversine_m(*(F.col(c) for c in ("src_x", "src_y", "dst_x", "dst_y"))), 3).alias("metres"))


@query(net("SELECT edge_id, round(distance_m / 1000, 6) AS km, round(distance_m / 1609.344::DOUBLE, 6) AS mi, round(distance_m / 0.3048::DOUBLE, 4) AS ft, round(distance_m / 0.0254::DOUBLE, 3) AS inches, round(speed_kph / 3.6::DOUBLE, 6) AS mps, round(grade * 100, 6) + 0.0 AS percent, round(distance_m * 3.6e6::DOUBLE / 1.26832984e8::DOUBLE, 6) AS gge, round((distance_m - 32) * 5 / 9, 6) AS celsius FROM E"))
def unit_convert(spark, sf_dir):
    c = lambda col, kind, a, b, n=6: F.round(units.convert(F.col(col), kind, a, b), n)
    return _edges(spark, sf_dir).select(
        "edge_id", c("distance_m", "distance", "m", "km").alias("km"), c("distance_m", "distance", "meters", "mi").alias("mi"), c("distance_m", "distance", "m", "ft", 4).alias("ft"), c("distance_m", "distance", "m", "in", 3).alias("inches"),
        c("speed_kph", "speed", "kph", "mps").alias("mps"), (c("grade", "ratio", "decimal", "percent") + 0.0).alias("percent"), c("distance_m", "energy", "kwh", "gge").alias("gge"), c("distance_m", "temperature", "f", "c").alias("celsius"),
    )


# -- energy -----------------------------------------------------------------------------------------------------------------

RATE = "(0.02::DOUBLE + 0.00002::DOUBLE * least(greatest(speed_kph / 1.609344::DOUBLE, 0), 100) * (least(greatest(grade * 100, -20), 20) + 20))"


def _grid(scale: float = 1.0, unit: str = "gallons_gasoline_per_mile", real_world: float = 1.1) -> energy.Prediction:
    inputs = [("edge_speed", "speed", "mph"), ("edge_grade", "ratio", "percent")]
    return energy.Prediction.of_function(lambda v, g: scale * (0.02 + 0.00002 * v * (g + 20)), inputs, [(0.0, 100.0, 11), (-20.0, 20.0, 9)], unit, real_world)


@query(net(f"SELECT edge_id, round({RATE}, 6) AS rate FROM E"))
def interp_2d(spark, sf_dir):
    e, s = _stepped(spark, sf_dir, [models.Speed(), models.Grade()])
    p = _grid()
    at = [s["edge_speed"], units.convert(s["edge_grade"], "ratio", "decimal", "percent")]
    return e.select("edge_id", F.round(Columns.grid(p.values, p.axes, at), 6).alias("rate"))


@query("SELECT round(min(1.1::DOUBLE * (0.02::DOUBLE + 0.00002::DOUBLE * v * (-0.2::DOUBLE * g + 20))), 6) AS rate, count(*) AS n FROM range(1, 101) a(v), range(0, 101) b(g), range(0, 12) c(t)")
def min_energy_rate(spark, sf_dir):
    return spark.sql(energy.best_rate_sql()).agg(F.round(F.lit(energy.best_rate(spark, _grid())), 6).alias("rate"), F.count("*").alias("n"))


@query(net(f"SELECT edge_id, round({RATE} * 1.1::DOUBLE * distance_m / 1609.344::DOUBLE, 6) AS gallons FROM E"))
def ice_energy(spark, sf_dir):
    e, s = _stepped(spark, sf_dir, [models.Speed(), models.Grade(), models.Distance(), energy.IceEnergy(_grid())])
    return e.select("edge_id", F.round(s["trip_energy_liquid"], 6).alias("gallons"))


@query(net(f"SELECT edge_id, round(greatest(0, least(1, 0.3::DOUBLE - {RATE} * 11::DOUBLE * distance_m / 1609.344::DOUBLE / 60)), 6) AS soc FROM E"))
def bev_energy(spark, sf_dir):
    m = energy.BevEnergy(_grid(10.0, "kilowatt_hours_per_mile"), 60.0)
    e, s = _stepped(spark, sf_dir, [models.Speed(), models.Grade(), models.Distance(), m], before={"trip_soc": F.lit(0.3)})
    return e.select("edge_id", F.round(s["trip_soc"], 6).alias("soc"))


@query(net(f", K AS (SELECT edge_id, {RATE} * 11::DOUBLE * distance_m / 1609.344::DOUBLE AS kwh, {RATE} * 1.1::DOUBLE * distance_m / 1609.344::DOUBLE AS gal FROM E) SELECT edge_id, round(least(kwh, 0.6::DOUBLE), 6) AS kwh, round(CASE WHEN kwh <= 0.6::DOUBLE THEN 0.0 ELSE gal * (1 - 0.6::DOUBLE / kwh) END, 6) + 0.0 AS gallons FROM K").replace("\n,", ",", 1))
def phev_energy(spark, sf_dir):
    m = energy.PhevEnergy(_grid(10.0, "kilowatt_hours_per_mile"), _grid(), 12.0)
    e, s = _stepped(spark, sf_dir, [models.Speed(), models.Grade(), models.Distance(), m], before={"trip_soc": F.lit(0.05)})
    return e.select("edge_id", F.round(s["trip_energy_electric"] / energy.KWH, 6).alias("kwh"), (F.round(s["trip_energy_liquid"], 6) + 0.0).alias("gallons"))


@query(net(", S AS (SELECT l_orderkey, list(metres / 1000.0::DOUBLE / 60 ORDER BY nr) AS used FROM legs GROUP BY l_orderkey) SELECT l_orderkey, round(list_reduce(list_prepend(0.5::DOUBLE, used), lambda a, b: greatest(0.0::DOUBLE, least(1.0::DOUBLE, a - b))), 6) AS soc FROM S").replace("\n,", ",", 1))
def bev_soc_fold(spark, sf_dir):
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    legs = lineitem.select("l_orderkey", F.row_number().over(w).alias("nr"), (F.floor(F.col("l_quantity") * 100) / 1000.0).alias("kwh"))
    trips = legs.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("nr", "kwh"))), lambda x: x["kwh"]).alias("used"))
    return trips.select("l_orderkey", F.round(F.aggregate("used", F.lit(0.5), lambda soc, kwh: energy.soc_after(Columns, soc, kwh, 60.0)), 6).alias("soc"))


@query(net("SELECT edge_id, round(CASE WHEN p_size < 25 AND distance_m < 2500 THEN (1 - distance_m / 12500) * 60 / 50 * 60 ELSE 0 END, 6) AS minutes, round(CASE WHEN p_size < 25 AND distance_m < 2500 THEN 1 ELSE distance_m / 12500 END, 6) AS soc FROM E JOIN part ON p_partkey = dst"))
def simple_charging(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    stations = part.filter("p_size < 25").select(F.col("p_partkey").alias("dst"), F.lit("DCFC").alias("station_type"), F.lit(50.0).alias("station_kw"))
    e = _edges(spark, sf_dir).join(stations, "dst", "left")
    state = {"trip_soc": F.col("distance_m") / 12500, "battery_capacity": F.lit(60.0 * energy.KWH), "edge_time": F.lit(0.0), "trip_time": F.lit(0.0)}
    s = energy.SimpleCharging(0.2, 1.0, ["DCFC"]).traverse(Columns, {c: F.col(c) for c in e.columns}, state, {})
    return e.select("edge_id", F.round(s["edge_charging_time"], 6).alias("minutes"), F.round(s["trip_soc"], 6).alias("soc"))


# -- cost -------------------------------------------------------------------------------------------------------------------


@query(net("SELECT edge_id, round(greatest(distance_m / 1000 * 0.5::DOUBLE, 1e-10) + greatest(distance_m / 1000 / speed_kph * 20, 1e-10), 6) AS total, round(2 * greatest(distance_m / 1000 * 0.5::DOUBLE, 1e-10) + 3 * greatest(distance_m / 1000 / speed_kph * 20, 1e-10), 6) AS objective FROM E"))
def cost_weighted(spark, sf_dir):
    chain = models.ordered([models.Distance(), models.Speed(), models.Time()])
    features = models.features_of(chain)
    model = CostModel({"trip_distance": 2.0, "trip_time": 3.0}, {"trip_distance": Rate("distance", 0.5, "km"), "trip_time": Rate("time", 20.0, "hours")}).checked(features)
    e, s = _stepped(spark, sf_dir, chain)
    objective, total = model.costs(Columns, features, {f.name: F.lit(f.initial) for f in features}, s, {c: F.col(c) for c in e.columns})
    return e.select("edge_id", F.round(total, 6).alias("total"), F.round(objective, 6).alias("objective"))


@query(net("SELECT edge_id, round(greatest(distance_m / 1000 + CASE WHEN p_size > 40 THEN p_size ELSE 0 END, 1e-10), 6) AS total FROM E JOIN part ON p_partkey = src"))
def network_cost(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    e = cost.with_network_costs(_edges(spark, sf_dir), vertex_costs=part.filter("p_size > 40").select(F.col("p_partkey").alias("vertex_id"), F.col("p_size").cast("double").alias("cost")))
    chain = [models.Distance()]
    features = models.features_of(chain)
    model = CostModel({"edge_distance": 1.0}, {"edge_distance": Rate("distance", 1.0, "km")}, {"edge_distance": ["network_cost"]}).checked(features)
    edge = {c: F.col(c) for c in e.columns}
    start = {f.name: F.lit(0.0) for f in features}
    _, total = model.costs(Columns, features, start, models.step(Columns, chain, features, edge, start, {}), edge)
    return e.select("edge_id", F.round(total, 6).alias("total"))


@query("SELECT l_orderkey, round(product(1 + l_discount), 6) AS mul, round(sum(l_quantity), 6) AS sum FROM lineitem GROUP BY l_orderkey")
def cost_aggregation(spark, sf_dir):
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    grouped = lineitem.groupBy("l_orderkey").agg(F.collect_list(1 + F.col("l_discount")).alias("d"), F.collect_list("l_quantity").alias("q"))
    return grouped.select("l_orderkey", F.round(cost.aggregate(F.col("d"), "mul"), 6).alias("mul"), F.round(cost.aggregate(F.col("q"), "sum"), 6).alias("sum"))


# -- constraints ------------------------------------------------------------------------------------------------------------


@query(net("SELECT edge_id, road_class FROM E WHERE road_class IN ('A', 'R')"))
def road_class_filter(spark, sf_dir):
    return RoadClass(["A", "R"]).prefilter(_edges(spark, sf_dir)).select("edge_id", "road_class")


@query(net("SELECT edge_id FROM E JOIN part ON p_partkey = dst WHERE 10 * 0.3048::DOUBLE <= p_size * 0.3048::DOUBLE AND NOT (p_size % 2 = 0 AND NOT 1500 * 0.45359237::DOUBLE < p_retailprice * 0.45359237::DOUBLE)"))
def vehicle_restriction(spark, sf_dir):
    e, (part,) = materialise(_edges(spark, sf_dir), "edges"), tables(spark, sf_dir, "part")
    at = e.join(part, e["dst"] == part["p_partkey"])
    rows = at.select("edge_id", F.lit("maximum_height").alias("name"), F.col("p_size").cast("double").alias("value"), F.lit("<=").alias("operation"), F.lit("feet").alias("unit"))
    weight = at.filter("p_size % 2 = 0").select("edge_id", F.lit("maximum_total_weight").alias("name"), F.col("p_retailprice").alias("value"), F.lit("<").alias("operation"), F.lit("lbs").alias("unit"))
    return VehicleRestriction(normalised_restrictions(rows.unionByName(weight)), [("height", 10.0, "ft"), ("total_weight", 1500.0, "pounds")]).prefilter(e).select("edge_id")


@query(net("SELECT a.dst AS vertex_id, count(*) AS n FROM E a JOIN E b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY a.dst"))
def turn_restriction(spark, sf_dir):
    """Turns that are allowed at each vertex: all pairs of an edge in and an edge out but those that go back. They are counted
    and not listed, as they are many times as many as edges."""
    e = materialise(_edges(spark, sf_dir).select("src", "dst"), "turns")
    back = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").groupBy(F.col("dst").alias("vertex_id")).agg(F.count("*").alias("n_back"))
    into, out = e.groupBy(F.col("dst").alias("vertex_id")).agg(F.count("*").alias("n_in")), e.groupBy(F.col("src").alias("vertex_id")).agg(F.count("*").alias("n_out"))
    turns = into.join(out, "vertex_id").join(back, "vertex_id", "left")
    return turns.select("vertex_id", (F.col("n_in") * F.col("n_out") - F.coalesce("n_back", F.lit(0))).alias("n")).filter("n > 0")


# -- requests ---------------------------------------------------------------------------------------------------------------


def _supplier_requests(spark, sf_dir) -> DataFrame:
    (supplier,) = tables(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    body = F.struct((F.lit(-105.0) + (k * 131 % 1000) / 1000.0).alias("origin_x"), (F.lit(39.0) + (k * 37 % 1000) / 1000.0).alias("origin_y"), (F.lit(-105.0) + (k * 17 % 1000) / 1000.0).alias("destination_x"), (F.lit(39.0) + (k * 71 % 1000) / 1000.0).alias("destination_y"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("zone"), F.col("s_nationkey").alias("load"))
    return shaping.requests_of(supplier.select(k.alias("query_id"), F.to_json(body).alias("request")))


SUPPLIERS = "S AS (SELECT s_suppkey AS query_id, s_nationkey, -105 + CAST(s_suppkey * 131 % 1000 AS DOUBLE) / 1000 AS ox, 39 + CAST(s_suppkey * 37 % 1000 AS DOUBLE) / 1000 AS oy, -105 + CAST(s_suppkey * 17 % 1000 AS DOUBLE) / 1000 AS dx, 39 + CAST(s_suppkey * 71 % 1000 AS DOUBLE) / 1000 AS dy FROM supplier)"


@query("SELECT CAST(n_nationkey AS BIGINT) AS query_id, CAST(i + 3 * j AS INT) AS combo_idx, ['a', 'b', 'c'][i + 1] AS bar, [1.2, 3.4][j + 1]::DOUBLE AS foo, n_name AS name FROM nation, range(0, 3) a(i), range(0, 2) b(j)")
def grid_search(spark, sf_dir):
    (nation,) = tables(spark, sf_dir, "nation")
    body = F.to_json(F.struct(F.col("n_name").alias("name"), F.from_json(F.lit('{"bar": ["a", "b", "c"], "foo": [1.2, 3.4]}'), "bar array<string>, foo array<double>").alias("grid_search")))
    rows = shaping.grid_search(shaping.requests_of(nation.select(F.col("n_nationkey").cast("long").alias("query_id"), body.alias("request"))))
    return rows.select("query_id", "combo_idx", shaping.json_value(F.col("request"), "bar").alias("bar"), shaping.number(F.col("request"), "foo").alias("foo"), shaping.json_value(F.col("request"), "name").alias("name"))


def _zones(spark) -> DataFrame:
    square = lambda x, y: [(x, y), (x + 0.4, y), (x + 0.4, y + 0.3), (x, y + 0.3)]
    rows = [(0, "100", square(-104.95, 39.05)), (1, "200", square(-104.75, 39.15)), (2, "300", square(-104.5, 39.6))]
    return spark.createDataFrame(rows, "order int, value string, ring array<struct<x:double,y:double>>")


ZONE = "CASE WHEN ox > -104.95 AND ox < -104.95 + 0.4 AND oy > 39.05 AND oy < 39.05 + 0.3 THEN 100 WHEN ox > -104.75 AND ox < -104.75 + 0.4 AND oy > 39.15 AND oy < 39.15 + 0.3 THEN 200 WHEN ox > -104.5 AND ox < -104.5 + 0.4 AND oy > 39.6 AND oy < 39.6 + 0.3 THEN 300 END"


@query(f"WITH {SUPPLIERS} SELECT query_id, CAST({ZONE} AS DOUBLE) AS fee FROM S")
def inject_point(spark, sf_dir):
    rows = shaping.inject_by_polygon(_supplier_requests(spark, sf_dir), _zones(spark), "fee")
    return rows.select("query_id", shaping.number(F.col("request"), "fee").alias("fee"))


@query(f"WITH {SUPPLIERS} SELECT query_id, coalesce(CAST({ZONE} AS DOUBLE), 7) AS fee FROM S")
def inject_default(spark, sf_dir):
    rows = shaping.inject_by_polygon(_supplier_requests(spark, sf_dir), _zones(spark), "fee", default=7)
    return rows.select("query_id", shaping.number(F.col("request"), "fee").alias("fee"))


@query("SELECT s_suppkey AS query_id, 'n' || s_nationkey AS zone, 'seen' AS extra FROM supplier")
def write_mode_ignore(spark, sf_dir):
    rows = shaping.inject_constant(shaping.inject_constant(_supplier_requests(spark, sf_dir), "zone", "other", "ignore"), "extra", "seen", "ignore")
    return rows.select("query_id", shaping.json_value(F.col("request"), "zone").alias("zone"), shaping.json_value(F.col("request"), "extra").alias("extra"))


@query(f"WITH {SUPPLIERS} SELECT query_id, round(2 * 6371 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(dy - oy) / 2), 2) + cos(radians(oy)) * cos(radians(dy)) * pow(sin(radians(dx - ox) / 2), 2)))), 6) AS km FROM S")
def weight_haversine(spark, sf_dir):
    return shaping.weight_haversine(_supplier_requests(spark, sf_dir)).select("query_id", F.round("query_weight_estimate", 6).alias("km"))


@query("SELECT s_suppkey AS query_id, CASE s_nationkey WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 7.0::DOUBLE ELSE 1.5::DOUBLE END AS weight FROM supplier")
def weight_categorical(spark, sf_dir):
    return shaping.weight_categorical(_supplier_requests(spark, sf_dir), "zone", {"n1": 5.0, "n2": 7.0}, 1.5).select("query_id", F.col("query_weight_estimate").alias("weight"))


@query("SELECT s_suppkey AS query_id, s_suppkey % 10 = 3 AS failed, CASE WHEN s_suppkey % 10 = 3 THEN 'not JSON' END AS error FROM supplier")
def response_errors(spark, sf_dir):
    rows = _supplier_requests(spark, sf_dir).withColumn("request", F.when(F.col("query_id") % 10 == 3, F.lit("{broken")).otherwise(F.col("request")))
    rows = rows.withColumn("error", F.when(F.expr("try_parse_json(request) IS NULL"), F.lit("not JSON")))
    good, bad = shaping.run_plugins(rows, [lambda df: shaping.inject_constant(df, "seen", True)])
    both = output.responses(good.select("query_id", "request", "error")).unionByName(output.responses(bad))
    return both.select("query_id", F.get_json_object("response", "$.error").isNotNull().alias("failed"), F.get_json_object("response", "$.error").alias("error"))


# -- matching ---------------------------------------------------------------------------------------------------------------

POINTS = "Q AS (SELECT c_custkey AS point_id, -105 + CAST(c_custkey * 613 % 4999 AS DOUBLE) / 4999 AS px, 39 + CAST(c_custkey * 1039 % 4999 AS DOUBLE) / 4999 AS py FROM customer)"


def _points(spark, sf_dir) -> DataFrame:
    (customer,) = tables(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return customer.select(k.alias("point_id"), (F.lit(-105.0) + (k * 613 % 4999) / 4999.0).alias("x"), (F.lit(39.0) + (k * 1039 % 4999) / 4999.0).alias("y"))


@query(net(f", {POINTS}, D AS (SELECT point_id, vertex_id, pow(px - x, 2) + pow(py - y, 2) AS d2 FROM Q, V), A AS (SELECT point_id, min(d2) AS d2 FROM D GROUP BY point_id) SELECT A.point_id, min(vertex_id) AS vertex_id, round(A.d2, 9) AS d2 FROM A JOIN D ON D.point_id = A.point_id AND D.d2 = A.d2 GROUP BY A.point_id, A.d2").replace("\n,", ",", 1))
def nearest_vertex(spark, sf_dir):
    return matching.nearest_vertex(_points(spark, sf_dir), _network(spark, sf_dir)).select("point_id", "vertex_id", F.round("d2", 9).alias("d2"))


HAVERSINE = "2 * 6371000 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(y - py) / 2), 2) + cos(radians(py)) * cos(radians(y)) * pow(sin(radians(x - px) / 2), 2))))"


@query(net(f", {POINTS}, D AS (SELECT point_id, px, py, vertex_id, x, y, pow(px - x, 2) + pow(py - y, 2) AS d2 FROM Q, V WHERE vertex_id IN (SELECT src FROM E)), A AS (SELECT point_id, min(d2) AS d2 FROM D GROUP BY point_id), M AS (SELECT A.point_id, min_by(D, D.vertex_id) AS m FROM A JOIN D ON D.point_id = A.point_id AND D.d2 = A.d2 GROUP BY A.point_id), X AS (SELECT point_id, m.vertex_id AS vertex_id, m.px AS px, m.py AS py, m.x AS x, m.y AS y FROM M) SELECT point_id, CASE WHEN {HAVERSINE} < 800 THEN vertex_id END AS vertex_id, {HAVERSINE} < 800 AS matched FROM X").replace("\n,", ",", 1))
def match_tolerance(spark, sf_dir):
    n = _network(spark, sf_dir)
    return matching.match_by_point(_points(spark, sf_dir), n, "origin", tolerance=800.0).select("point_id", "vertex_id", F.col("error").isNull().alias("matched"))


@query(net("SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE WHEN n_nationkey * 3 IN (SELECT src FROM E) THEN CAST(n_nationkey * 3 AS BIGINT) END AS origin FROM nation"))
def match_by_id(spark, sf_dir):
    (nation,) = tables(spark, sf_dir, "nation")
    rows = nation.select(F.col("n_nationkey").cast("long").alias("point_id"), (F.col("n_nationkey") * 3).cast("long").alias("vertex_id"))
    made = matching.match_by_vertex(rows, _network(spark, sf_dir), "origin")
    return made.select(F.col("point_id").alias("query_id"), F.when(F.col("error").isNull(), F.col("vertex_id")).alias("origin"))


# -- searches ---------------------------------------------------------------------------------------------------------------


@query(SEARCH + "SELECT q AS query_id, v AS vertex_id, g FROM B")
def sssp_cost(spark, sf_dir):
    tree = least_costs(derived_network(spark, sf_dir).cached(), _trees(_requests(spark, sf_dir)), _metres())
    return tree.select("query_id", "vertex_id", _g().alias("g"))


@query(SEARCH + "SELECT q AS query_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS total FROM B GROUP BY q")
def sssp_tree_size(spark, sf_dir):
    tree = least_costs(derived_network(spark, sf_dir).cached(), _trees(_requests(spark, sf_dir)), _metres())
    return tree.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(_g()).alias("total"))


@query(f"WITH {NET.strip()},\n{NATIONS},\n{relaxed_sql('dst', 'src')} SELECT q AS query_id, v AS vertex_id, g FROM b{ROUNDS}")
def sssp_reverse(spark, sf_dir):
    tree = least_costs(derived_network(spark, sf_dir).cached(), _trees(_requests(spark, sf_dir)), _metres(direction="reverse"))
    return tree.select("query_id", "vertex_id", _g().alias("g"))


@query(f"WITH {NET.strip()},\n{NATIONS},\n{relaxed_sql(rounds=3)} SELECT q AS query_id, v AS vertex_id, g FROM b3")
def iteration_limit(spark, sf_dir):
    tree = least_costs(derived_network(spark, sf_dir).cached(), _trees(_requests(spark, sf_dir)), _metres(limits=Limits(rounds=3, strict=False)))
    return tree.select("query_id", "vertex_id", _g().alias("g"))


@query(SEARCH + "SELECT q AS query_id, v AS vertex_id, g FROM B")
def kernel_cost(spark, sf_dir):
    tree = kernel(derived_network(spark, sf_dir).cached(), _trees(_requests(spark, sf_dir)), _metres())
    return tree.select("query_id", "vertex_id", _g().alias("g"))


def _routes(spark, sf_dir) -> tuple[graph.Network, DataFrame, Setup]:
    n, r, s = derived_network(spark, sf_dir).cached(), materialise(_requests(spark, sf_dir), "asked"), _metres()
    return n, paths.routes(trees(n, r, s, ways=True), r), s


@query(SEARCH + "SELECT q AS query_id, d AS destination, g FROM R JOIN B USING (q) WHERE v = d")
def od_route_cost(spark, sf_dir):
    n, r = derived_network(spark, sf_dir).cached(), materialise(_requests(spark, sf_dir), "asked")
    ends = r.select("query_id", F.col("destination").alias("vertex_id"))
    return least_costs(n, r, _metres()).join(ends, ["query_id", "vertex_id"]).select("query_id", F.col("vertex_id").alias("destination"), _g().alias("g"))


@query(SEARCH + "SELECT query_id, CAST(pos AS INT) AS pos, edge_id, src AS from_vertex, dst AS to_vertex, CAST(distance_m AS BIGINT) AS metres FROM L")
def route_edges(spark, sf_dir):
    _, rows, _ = _routes(spark, sf_dir)
    return rows.select("query_id", "pos", "edge_id", "from_vertex", "to_vertex", _g("objective_cost").alias("metres"))


@query(SEARCH + "SELECT query_id, edge_id FROM L WHERE back < 2")
def route_depth(spark, sf_dir):
    n, r = derived_network(spark, sf_dir).cached(), materialise(_requests(spark, sf_dir), "asked")
    return paths.backtrack(trees(n, r, _metres(), ways=True), r.select("query_id", F.col("destination").alias("vertex_id")), depth=2).select("query_id", "edge_id")


@query(SEARCH + "SELECT query_id, CAST(sum(distance_m) AS BIGINT) AS trip_metres, round(sum(distance_m) / 1609.344::DOUBLE, 6) AS edge_distance, count(*) AS n_edges, CAST(sum(distance_m) AS BIGINT) AS total_cost FROM L GROUP BY query_id")
def route_summary(spark, sf_dir):
    _, rows, s = _routes(spark, sf_dir)
    made = output.path_summary(rows, s.features)
    return made.select("query_id", _g("trip_metres").alias("trip_metres"), F.round("edge_distance", 6).alias("edge_distance"), "n_edges", _g("total_cost").alias("total_cost"))


@query(SEARCH + "SELECT query_id, 'LINESTRING (' || string_agg(CAST(CAST(a.x AS FLOAT) AS VARCHAR) || ' ' || CAST(CAST(a.y AS FLOAT) AS VARCHAR) || ', ' || CAST(CAST(b.x AS FLOAT) AS VARCHAR) || ' ' || CAST(CAST(b.y AS FLOAT) AS VARCHAR), ', ' ORDER BY pos) || ')' AS route FROM L JOIN V a ON a.vertex_id = src JOIN V b ON b.vertex_id = dst GROUP BY query_id")
def route_wkt(spark, sf_dir):
    n, rows, s = _routes(spark, sf_dir)
    return output.route_output(rows, "wkt", s.features, n.straight_lines()).select("query_id", "route")


@query(SEARCH + "SELECT query_id, count(*) AS n_features, arg_min(edge_id, pos) AS first_edge, arg_max(edge_id, pos) AS last_edge FROM L GROUP BY query_id")
def route_geojson(spark, sf_dir):
    n, rows, s = _routes(spark, sf_dir)
    made = output.route_output(rows, "geo_json", s.features, n.straight_lines())
    ids = F.from_json(F.get_json_object("route", "$.features[*].properties.edge_id"), "array<long>")
    one = F.when(F.get_json_object("route", "$.features[*].properties.edge_id").startswith("["), ids).otherwise(F.array(F.get_json_object("route", "$.features[*].properties.edge_id").cast("long")))
    return made.select("query_id", F.size(one).cast("long").alias("n_features"), one[0].alias("first_edge"), F.element_at(one, -1).alias("last_edge"))


@query(SEARCH + "SELECT R.q AS query_id, (SELECT count(*) - 1 FROM B WHERE B.q = R.q) AS tree_size, (SELECT count(*) FROM L WHERE L.query_id = R.q) AS route_edges, CAST(EXISTS (SELECT 1 FROM L WHERE L.query_id = R.q) AS BIGINT) AS n_routes FROM R")
def run_summary(spark, sf_dir):
    n, r = derived_network(spark, sf_dir).cached(), materialise(_requests(spark, sf_dir), "asked")
    tree = trees(n, _trees(r), _metres())
    return output.run_summary(tree, paths.routes(trees(n, r, _metres(), ways=True), r), r).select("query_id", "tree_size", "route_edges", "n_routes")


@query()
def turn_delay_routes(spark, sf_dir):
    n, r = derived_network(spark, sf_dir).cached(), _requests(spark, sf_dir)
    setup = Setup([models.Distance(), models.Speed(), models.Time(), models.TurnDelay(DELAYS)], CostModel({"trip_time": 1.0}, {"trip_time": Rate("raw")}))
    return paths.edge_lists(paths.routes(trees(n, r, setup, ways=True), r)).select("query_id", F.size("edges").alias("n_edges"), F.round("objective_cost", 6).alias("minutes"))


@query()
def svp_routes(spark, sf_dir):
    made = ksp.single_via(derived_network(spark, sf_dir).cached(), materialise(_requests(spark, sf_dir), "asked"), _metres(), k=3, candidates=10)
    return made.select("query_id", "route_idx", F.round("cost", 3).alias("cost"), F.size("edges").alias("n_edges"))


@query()
def yens_routes(spark, sf_dir):
    made = ksp.yens(derived_network(spark, sf_dir).cached(), materialise(_requests(spark, sf_dir), "asked"), _metres(), k=2)
    return made.select("query_id", "route_idx", F.round("cost", 3).alias("cost"), F.size("edges").alias("n_edges"))


def _order_routes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    rows = lineitem.groupBy("l_orderkey", F.col("l_partkey").alias("edge_id")).agg(F.min("l_quantity").alias("distance_m"))
    a = rows.select(F.col("l_orderkey").alias("query_id"), F.lit(0).alias("edge_list_id"), "edge_id", "distance_m")
    return a, a.withColumn("query_id", F.col("query_id") - 1)


PAIRS = "WITH a AS (SELECT l_orderkey AS q, l_partkey AS e, {w} AS w FROM lineitem GROUP BY l_orderkey, l_partkey), b AS (SELECT q - 1 AS q, e, w FROM a), n AS (SELECT coalesce(a.q, b.q) AS query_id, coalesce(a.w, 0.0) AS wa, coalesce(b.w, 0.0) AS wb FROM a FULL JOIN b ON a.q = b.q AND a.e = b.e) SELECT query_id, round(CASE WHEN sqrt(sum(wa * wa)) * sqrt(sum(wb * wb)) > 0 THEN sum(wa * wb) / (sqrt(sum(wa * wa)) * sqrt(sum(wb * wb))) ELSE 0 END, 6) AS similarity FROM n GROUP BY query_id"


@query(PAIRS.format(w="1.0::DOUBLE"))
def similarity_cosine(spark, sf_dir):
    return ksp.cosine(*_order_routes(spark, sf_dir), ["query_id"]).select("query_id", F.round("similarity", 6).alias("similarity"))


@query(PAIRS.format(w="min(l_quantity)"))
def similarity_weighted(spark, sf_dir):
    return ksp.cosine(*_order_routes(spark, sf_dir), ["query_id"], True).select("query_id", F.round("similarity", 6).alias("similarity"))


# -- files and text ---------------------------------------------------------------------------------------------------------


def _order_responses(spark, sf_dir) -> DataFrame:
    (orders,) = tables(spark, sf_dir, "orders")
    body = F.struct(F.struct(F.col("o_custkey").alias("a"), F.struct(F.col("o_totalprice").alias("price")).alias("deep")).alias("cost"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("note"))
    return orders.select(F.col("o_orderkey").alias("query_id"), F.to_json(body).alias("response"))


@query("SELECT o_orderkey AS query_id, round(o_custkey + o_totalprice, 4) AS total FROM orders")
def csv_mapping_sum(spark, sf_dir):
    made = sinks.mapped(_order_responses(spark, sf_dir), {"total": {"sum": ["cost.a", "cost.deep.price", "cost.none"], "dtype": "float"}})
    return made.select("query_id", F.round("total", 4).alias("total"))


@query("SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS note, o_custkey AS a, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'strict: nothing at ''note''' END AS error FROM orders")
def json_optional(spark, sf_dir):
    made = sinks.mapped(_order_responses(spark, sf_dir), {"note": {"optional": "note"}, "a": {"path": "cost.a", "dtype": "int"}, "strict": "note"})
    return made.select("query_id", "note", "a", "error")


PRICE = "CASE p_partkey % 7 WHEN 0 THEN '$' || d || ' per kWh' WHEN 1 THEN '$' || d || '/kWh' WHEN 2 THEN '$' || d || ' kWh' WHEN 3 THEN '$2.00 session fee + $' || d || '/kWh' WHEN 4 THEN '$5.00 flat rate' WHEN 5 THEN 'Free' END"


@query(f"WITH t AS (SELECT p_partkey, '0.' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS d FROM part), p AS (SELECT p_partkey, {PRICE} AS price FROM t) SELECT p_partkey, CASE WHEN price IS NULL OR contains(lower(price), 'free') THEN 0.0::DOUBLE ELSE coalesce(TRY_CAST(nullif(regexp_extract(price, '(?i)\\$(\\d+\\.?\\d*)\\s*per\\s*kWh', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(price, '(?i)\\$(\\d+\\.?\\d*)/kWh', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(price, '(?i)\\$(\\d+\\.?\\d*)\\s*kWh', 1), '') AS DOUBLE), 0) END AS dollars FROM p")
def price_parse(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    price = part.select("p_partkey", F.concat(F.lit("0."), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("d")).select("p_partkey", F.expr(PRICE).alias("price"))
    return price.select("p_partkey", text.price_per_kwh(F.col("price")).alias("dollars"))


@query("SELECT x, y, power_type, CAST(power_kw AS DOUBLE) AS power_kw, cost_per_kwh FROM (SELECT CAST(s_suppkey AS DOUBLE) AS x, 1.0::DOUBLE AS y, 0.2::DOUBLE AS cost_per_kwh, s_suppkey % 2 AS a, s_suppkey % 3 AS b, s_suppkey % 5 AS c FROM supplier) s, (VALUES ('L1', 1.8), ('L2', 7.2), ('DCFC', 150.0)) p(power_type, power_kw) WHERE (power_type = 'L1' AND a > 0) OR (power_type = 'L2' AND b > 0) OR (power_type = 'DCFC' AND c > 0)")
def station_fanout(spark, sf_dir):
    (supplier,) = tables(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return dataset.station_rows(supplier.select(k.cast("double").alias("longitude"), F.lit(1.0).alias("latitude"), (k % 2).alias("ev_level1_num"), (k % 3).alias("ev_level2_num"), (k % 5).alias("ev_dc_fast_num"), F.lit("$0.20/kWh").alias("ev_pricing")))


@query("WITH m AS (SELECT o_orderkey, CAST(o_orderkey * 1234577 AS BIGINT) AS ms FROM orders) SELECT o_orderkey, CASE WHEN ms >= 86400000 THEN '+' || (ms // 86400000) || '.' ELSE '' END || (ms % 86400000 // 3600000) || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS duration FROM m")
def duration_text(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return orders.select("o_orderkey", text.duration(F.col("o_orderkey") * 1234577).alias("duration"))


@query(net(", P AS (SELECT x, y FROM V) SELECT DISTINCT format('n{:02d}w{:03d}', CAST(ceil(y) AS INT), CAST(ceil(-x) AS INT)) AS tile FROM P").replace("\n,", ",", 1))
def elevation_tiles(spark, sf_dir):
    return dataset.elevation_tiles(_network(spark, sf_dir).vertices)


@query("SELECT p_partkey AS osmid, row_number() OVER (ORDER BY p_partkey) - 1 AS vertex_id FROM part")
def vertex_numbering(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return dataset.vertices_of(part.select(F.col("p_partkey").alias("osmid"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).select("osmid", "vertex_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from wayfold import operator_queries  # noqa: F401  adds to QUERIES and ORACLE

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least costs from each nation's origin to every vertex."""
    return sssp_cost(spark, sf_dir)
