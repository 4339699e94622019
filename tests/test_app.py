import gzip
import json

import pytest
from pyspark.sql import functions as F

from tests.networks import SQUARE, kilometres, network, requests
from wayfold import cli
from wayfold.app import App
from wayfold.operators import energy, output
from wayfold.operators.graph import NetworkError
from wayfold.plans.paths import labels_at, parents, routes
from wayfold.plans.search import relax
from wayfold.registry import default_registry
from wayfold.sources import config as cfg
from wayfold.sources import dataset, files, sinks
from wayfold.streaming.requests import answer_stream, request_stream


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "vertices.csv").write_text("extra,x,vertex_id,y\n9,0.0,0,0.0\n9,1.0,1,0.0\n9,1.0,2,1.0\n9,0.0,3,1.0\n")
    rows = "\n".join(f"{i},{s},{d},{k * 1000},a" for i, (s, d, k) in enumerate(SQUARE))
    with gzip.open(tmp_path / "edges.csv.gz", "wt") as f:
        f.write(f"edge_id,src_vertex_id,dst_vertex_id,distance,road_class\n{rows}\n")
    (tmp_path / "speeds.txt").write_text("\n".join("60" for _ in SQUARE) + "\n")
    (tmp_path / "lines.txt").write_text("\n".join(f"LINESTRING ({s} 0, {d} 1)" for s, d, _ in SQUARE))
    (tmp_path / "app.toml").write_text(
        """
[graph]
vertex_list_input_file = "vertices.csv"
edge_list_input_file = "edges.csv.gz"
[attributes.speed_kph]
input_file = "speeds.txt"
[mapping]
geometry_input_file = "lines.txt"
[traversal]
type = "combined"
models = [{type = "distance"}, {type = "speed"}, {type = "time"}]
[cost.weights]
trip_distance = 1.0
[cost.vehicle_rates]
trip_distance = {type = "distance", factor = 1.0, unit = "kilometers"}
trip_time = {type = "time", factor = 1.0, unit = "minutes"}
[plugin]
input_plugins = [{type = "grid_search"}]
output_plugins = [{type = "summary"}, {type = "traversal", route = "edge_id", tree = "edge_id"}]
"""
    )
    return tmp_path


def edges_of(response):
    return [e["edge_id"] for e in json.loads(response["route"])]


def test_from_file_to_responses(spark, folder):
    app = App.from_config_file(spark, folder / "app.toml")
    got = app.run([{"origin_vertex": 0, "destination_vertex": 1, "name": "kept"}, {"origin_x": 0.1, "origin_y": 0.9, "destination_x": 1.0, "destination_y": 0.1}, {"origin_vertex": 77}, {"origin_vertex": 0}])
    by = {json.loads(r["request"]).get("name", str(i)): r for i, r in enumerate(got)}
    assert len(got) == 4 and edges_of(by["kept"]) == [7, 5, 3]
    assert by["kept"]["traversal_summary"]["trip_distance"] == pytest.approx(5000 / 1609.344) and by["kept"]["route_edges"] == 3
    assert sum("error" in r for r in got) == 1
    one = app.run({"origin_vertex": 0, "grid_search": {"weights": [{"weights": {"trip_distance": 1.0}}, {"weights": {"trip_distance": 0.0, "trip_time": 2.0}}], "destination_vertex": [1, 2]}})
    assert isinstance(one, dict)
    assert app.edge_origin(2) == 1 and app.edge_destination(2) == 2 and app.edge_distance(2, unit="km") == 2 and app.out_edge_ids(0) == [0, 7] and app.in_edge_ids(0) == [1, 6]
    with pytest.raises(NetworkError):
        app.edge_origin(99)


def test_answers_keep_the_order_of_requests_and_combinations(spark, folder):
    app = App.from_config_file(spark, folder / "app.toml")
    grid = {"origin_vertex": 0, "destination_vertex": 1, "grid_search": {"weights": [{"weights": {"trip_distance": 1.0}}, {"weights": {"trip_distance": 2.0}}, {"weights": {"trip_distance": -1.0}}]}}
    got = app.run([{"grid_search": 3}, grid, {"origin_vertex": 0, "destination_vertex": 2, "name": "last"}])
    assert len(got) == 5 and "grid_search" in got[0]["error"] and json.loads(got[4]["request"])["name"] == "last"
    cost = lambda g: round(g["traversal_summary"]["objective_cost"], 6)
    assert (cost(got[1]), cost(got[2])) == (5, 10) and "negative" in got[3]["error"]
    # One search for the requests that differ in their ends and weights only.
    assert cost(got[4]) == 3 and got[2]["search_seconds"] == got[1]["search_seconds"] != got[4]["search_seconds"]


def test_a_request_that_ends_early_is_an_error_of_its_own(spark, folder):
    config = cfg.merge(cfg.load(folder / "app.toml"), {"termination": {"type": "iterations", "limit": 1}})
    near, far = App.from_dict(spark, config).run([{"origin_vertex": 0, "destination_vertex": 3}, {"origin_vertex": 0, "destination_vertex": 2}])
    assert edges_of(near) == [7] and "ended early" in far["error"]


def test_edges_at_the_ends_are_part_of_routes_and_alternatives(spark, folder):
    config = cfg.merge(cfg.load(folder / "app.toml"), {"mapping": {"matching_type": ["edge"]}})
    asked = {"origin_edge": 7, "destination_edge": 3}  # 0 to 3, then 3 to 2, then 2 to 1
    assert edges_of(App.from_dict(spark, config).run(asked)) == [7, 5, 3]
    assert edges_of(App.from_dict(spark, config).run({"origin_edge": 7, "destination_edge": 5})) == [7, 5]
    route = json.loads(App.from_dict(spark, cfg.merge(config, {"algorithm": {"type": "yens", "k": 1}})).run(asked)["route"])
    assert [e["edge_id"] for e in route["edges"]] == [7, 5, 3]


def test_polygons_of_a_configuration(spark, folder):
    ring = [[-0.5, -0.5], [0.5, -0.5], [0.5, 0.5], [-0.5, 0.5], [-0.5, -0.5]]
    (folder / "zones.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"weights": {"trip_distance": 3.0}}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    plugins = [{"type": "inject", "spatial_input_file": str(folder / "zones.json"), "source_key": "weights", "key": "weights"}]
    config = cfg.merge(cfg.load(folder / "app.toml"), {"plugin": {"input_plugins": plugins}})
    inside, outside = App.from_dict(spark, config).run([{"origin_x": 0.1, "origin_y": 0.1, "destination_vertex": 3}, {"origin_x": 1.0, "origin_y": 1.0, "destination_vertex": 3}])
    assert (inside["traversal_summary"]["objective_cost"], outside["traversal_summary"]["objective_cost"]) == (6.0, 1.0)


def test_bad_requests_do_not_stop_the_others(spark, folder):
    app = App.from_config_file(spark, folder / "app.toml")
    got = app.run([{"origin_vertex": 0, "destination_vertex": 1}, {"origin_vertex": 0, "destination_vertex": 1, "weights": {"nothing": 1.0}}, {"origin_vertex": 0, "destination_vertex": 1, "state_features": {"x": 1}}])
    assert sorted("error" in r for r in got) == [False, True, True]


def test_constraints_costs_stations_and_vehicles_of_a_configuration(spark, folder):
    (folder / "limits.csv").write_text("edge_id,name,value,operation,unit\n7,height,3,<,meters\n")
    (folder / "turns.csv").write_text("prev_edge_id,next_edge_id\n2,4\n")
    (folder / "fees.csv").write_text("vertex_id,cost\n3,100\n")
    (folder / "stations.csv").write_text("power_type,power_kw,cost_per_kwh,x,y\ndcfc,150,0.3,0.0,0.1\n")
    base = cfg.load(folder / "app.toml")
    limited = cfg.merge(base, {"constraint": {"type": "vehicle_restriction", "vehicle_restriction_input_file": str(folder / "limits.csv")}})
    app = App.from_dict(spark, limited)
    low, high, none = app.run([{"origin_vertex": 0, "destination_vertex": 3, "vehicle_parameters": p} for p in ([{"type": "height", "value": 2, "unit": "meters"}], [{"type": "height", "value": 20, "unit": "feet"}])] + [{"origin_vertex": 0, "destination_vertex": 3}])
    assert edges_of(low) == [7] and edges_of(high) == [0, 2, 4] and "vehicle_parameters" in none["error"]
    turned = cfg.merge(base, {"constraint": {"type": "combined", "models": [{"type": "no_restriction"}, {"type": "turn_restriction", "turn_restriction_input_file": str(folder / "turns.csv")}]}})
    assert edges_of(App.from_dict(spark, turned).run({"origin_vertex": 1, "destination_vertex": 3})) == [1, 7]
    priced = cfg.merge(base, {"cost": {"vertex_cost_input_file": str(folder / "fees.csv"), "weights": {"edge_distance": 1.0, "trip_distance": 0.0}, "vehicle_rates": {"edge_distance": {"type": "distance", "factor": 1.0, "unit": "km"}}, "network_rates": {"edge_distance": ["vertex_cost"]}}})
    assert edges_of(App.from_dict(spark, priced).run({"origin_vertex": 0, "destination_vertex": 2})) == [0, 2]
    grid = energy.Prediction([("edge_speed", "speed", "mph")], [(0.0, 100.0, 2)], [0.5, 0.5], "kilowatt_hours_per_mile")
    fleet = energy.VehicleLibrary({"E": ("bev", {"prediction": grid, "capacity_kwh": 1.0})})
    electric = cfg.merge(base, {"charging_station_input_file": str(folder / "stations.csv"), "traversal": {"type": "combined", "models": [{"type": "distance"}, {"type": "speed"}, {"type": "time"}, {"type": "energy"}, {"type": "simple_charging"}]}, "response_persistence_policy": "persist_response_in_memory"})
    app = App.from_dict(spark, electric, vehicles=fleet)
    got, lost = app.run([{"origin_vertex": 3, "destination_vertex": 1, "model_name": "E", "starting_soc_percent": 50, "weights": {"trip_distance": 1.0}}, {"origin_vertex": 3, "destination_vertex": 1, "model_name": "X"}])
    assert got["traversal_summary"]["trip_energy_electric"] > 0 and "unknown vehicle" in lost["error"]
    assert App.from_dict(spark, cfg.merge(base, {"response_persistence_policy": "discard_response_from_memory"})).run([{"origin_vertex": 0}]) == []


@pytest.mark.parametrize("algorithm", [{"type": "yens", "k": 2}, {"type": "single_via_paths", "k": 2, "similarity": {"type": "edge_id_cosine", "threshold": 0.9}}])
def test_alternatives(spark, folder, algorithm):
    config = cfg.merge(cfg.load(folder / "app.toml"), {"algorithm": algorithm})
    got = App.from_dict(spark, config).run({"origin_vertex": 0, "destination_vertex": 1})
    first = json.loads(got["route"])
    first = first[0] if isinstance(first, list) else first
    assert first["cost"] == 5.0 and [e["edge_id"] for e in first["edges"]] == [7, 5, 3]


def test_command_line(spark, folder, monkeypatch):
    (folder / "q.json").write_text(json.dumps([{"origin_vertex": 0, "destination_vertex": 2}]))
    (folder / "q.ndjson").write_text('{"origin_vertex": 0, "destination_vertex": 2}\n\n{bad\n')
    assert cli.main(["--config-file", str(folder / "app.toml"), "--query-file", str(folder / "q.json"), "--output-directory", str(folder / "out")]) == 0
    assert spark.read.text(str(folder / "out/responses")).count() == 1
    assert cli.main(["--config-file", str(folder / "app.toml"), "--query-file", str(folder / "q.ndjson"), "--newline-delimited", "--output-directory", str(folder / "out2"), "--parallelism", "2"]) == 0
    assert sorted("error" in json.loads(r.value) for r in spark.read.text(str(folder / "out2/responses")).collect()) == [False, True]
    with pytest.raises(SystemExit):
        cli.arguments(["--config-file", "a", "--query-file", "b", "--chunksize", "5"])
    args = cli.arguments(["--config-file", "a", "--query-file", "b", "--output-directory", "/new"])
    assert cli.overridden({"response_output_policy": {"type": "file", "filename": "old/x.json"}}, args)["response_output_policy"]["filename"] == "/new/x.json"


def test_stream(spark, folder):
    (folder / "in").mkdir()
    (folder / "in/a.json").write_text('{"origin_vertex": 0, "destination_vertex": 2}\n{bad\n')
    (folder / "in/b.json").write_text('{"origin_vertex": 1, "destination_vertex": 3}\n')
    app = App.from_config_file(spark, folder / "app.toml")
    answer_stream(app, request_stream(spark, str(folder / "in")), str(folder / "answers"), str(folder / "check")).awaitTermination()
    rows = spark.read.parquet(str(folder / "answers")).collect()
    assert len(rows) == 3 and {r.batch for r in rows} == {0, 1} and sum("error" in json.loads(r.response) for r in rows) == 1


def test_configuration(folder):
    made = cfg.load(folder / "app.toml")
    assert made["parallelism"] == 2 and made["termination"]["limit"] == "00:01:00" and made["graph"]["vertex_list_input_file"].endswith("vertices.csv")
    assert cfg.get(made, "cost.weights.trip_distance", float) == 1.0 and cfg.get(made, "no.key", str, "x") == "x" and cfg.one_or_many(3) == [3] and cfg.one_or_many([3]) == [3]
    for call in (lambda: cfg.get(made, "no.key"), lambda: cfg.get(made, "parallelism", str), lambda: cfg.load(folder / "none.toml"), lambda: cfg.resolved({"x_input_file": "none"}, folder), lambda: cfg.parsed({"a": "x"}, "a", int)):
        with pytest.raises(cfg.ConfigError):
            call()


def test_registry():
    r = default_registry()
    assert len(r.names()["traversal"]) >= 10 and len(r.names()["constraint"]) == 5 and len(r.names()["label"]) == 2 and len(r.names()["input"]) == 4 and len(r.names()["output"]) == 3
    r.register("constraint", "mine", lambda spec, context: spec["value"])
    assert r.build("constraint", {"type": "mine", "value": 4}) == 4
    for bad in (lambda: r.build("label", {"type": "x"}), lambda: r.register("odd", "x", None)):
        with pytest.raises(ValueError):
            bad()


def test_network_files(spark, folder):
    n = files.read_network(spark, str(folder / "vertices.csv"), [str(folder / "edges.csv.gz"), str(folder / "edges.csv.gz")])
    assert n.counts().first().asDict() == {"n_vertices": 4, "n_edges": 16, "n_edge_lists": 2}
    assert n.incident_triplets(spark.createDataFrame([(0,)], "vertex_id long")).count() == 4
    one = files.read_network(spark, str(folder / "vertices.csv"), str(folder / "edges.csv.gz"))
    assert files.read_lines_of_edges(spark, str(folder / "lines.txt"), one).count() == 8
    assert [r.value for r in files.read_lines(spark, str(folder / "speeds.txt")).orderBy("row").collect()] == ["60"] * 8
    (folder / "bad.txt").write_text("1\nx\n")
    for call in (lambda: files.read_attribute(spark, str(folder / "bad.txt"), "f64"), lambda: files.read_lines_of_edges(spark, str(folder / "bad.txt"), one), lambda: files.read_csv(spark, str(folder / "vertices.csv"), "nothing long"), lambda: one.with_attribute(spark.createDataFrame([(0, 1.0)], "edge_id long, value double"), "v")):
        with pytest.raises(NetworkError):
            call()
    (folder / "headings.csv").write_text("arrival_heading,departure_heading\n10,20\n30,\n")
    assert [(r.arrival_heading, r.departure_heading) for r in files.read_headings(spark, str(folder / "headings.csv")).orderBy("edge_id").collect()] == [(10, 20), (30, 30)]
    decoded = spark.createDataFrame([(" 7 ",), ("300",), ("-1",), ("true",)], "v string")
    assert [r[0] for r in decoded.select(files.decode(F.col("v"), "u8")).collect()] == [7, None, None, None]


def test_stations(spark, folder):
    n = files.read_network(spark, str(folder / "vertices.csv"), str(folder / "edges.csv.gz"))
    (folder / "stations.csv").write_text("power_type,power_kw,cost_per_kwh,x,y\nl2,7.2,0.1,0.1,0\ndcfc,150,0.3,0.0,0.1\nL1,1.8,0,1,0.9\n")
    got = {r.vertex_id: (r.power_type, r.power_kw) for r in files.read_stations(spark, str(folder / "stations.csv"), n).collect()}
    assert got == {0: ("DCFC", 150.0), 2: ("L1", 1.8)}
    at = files.with_stations(n, files.read_stations(spark, str(folder / "stations.csv"), n)).edges
    assert at.filter("dst = 0 AND station_kw = 150").count() == 2


def test_polygons_and_requests(spark, folder):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    good = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"fee": 5}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {"fee": 6}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}
    (folder / "p.json").write_text(json.dumps(good, indent=1))
    got = files.read_polygons(spark, str(folder / "p.json"), "fee").orderBy("order").collect()
    assert [(r.order, r.value, len(r.ring)) for r in got] == [(0, "5", 4), (1, "6", 4), (1, "6", 4)]
    with pytest.raises(NetworkError):
        files.read_polygons(spark, str(folder / "p.json"), "none")
    (folder / "one.json").write_text('{\n "a": 1}')
    (folder / "many.json").write_text('[{"a": 1},\n {"a": {"b": [2]}}]')
    assert [json.loads(r.request) for r in files.read_requests(spark, str(folder / "one.json")).collect()] == [{"a": 1}]
    assert [json.loads(r.request) for r in files.read_requests(spark, str(folder / "many.json")).collect()] == [{"a": 1}, {"a": {"b": [2]}}]


def responses(spark):
    return spark.createDataFrame([(0, '{"a": {"b": 1.5, "c": 2}, "s": "x, \\"y\\""}'), (1, '{"a": {"b": "text"}}')], "query_id long, response string")


def test_mappings_and_sinks(spark, tmp_path):
    mapping = {"b": "a.b", "total": {"sum": ["a.b", "a.c", "a.none"]}, "s": {"optional": "s"}}
    rows = sinks.mapped(responses(spark), mapping).orderBy("query_id").collect()
    assert (rows[0].b, rows[0].total, rows[0].s, rows[0].error) == ("1.5", "3.5", 'x, "y"', None)
    assert rows[1].total is None and rows[1].s is None and "no number" in rows[1].error
    assert sinks.mapped(responses(spark), mapping, True).columns == ["query_id", "b", "s", "total", "error"]
    for spec in ({"type": "file", "format": {"type": "csv", "mapping": mapping}, "filename": f"{tmp_path}/c"}, {"type": "parquet", "path": f"{tmp_path}/p", "mapping": {"b": {"path": "a.b", "dtype": "float"}}}, {"type": "file", "format": {"type": "json", "newline_delimited": True}, "filename": f"{tmp_path}/n.gz"}, {"type": "file", "format": {"type": "json"}, "filename": f"{tmp_path}/j.json", "write_mode": "overwrite"}, None):
        sinks.sink_of(spec).write(responses(spark))
    assert {r.s for r in spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/c").collect()} == {'x, "y"', None}
    assert dict(spark.read.parquet(f"{tmp_path}/p").dtypes)["b"] == "double" and spark.read.text(f"{tmp_path}/n.gz").count() == 2
    assert len(json.loads((tmp_path / "j.json").read_text())) == 2
    sinks.Sink("json", f"{tmp_path}/j.json").write(responses(spark))
    assert len(json.loads((tmp_path / "j.json").read_text())) == 4
    sinks.sink_of([{"type": "parquet", "path": f"{tmp_path}/x"}, {"type": "parquet", "path": f"{tmp_path}/y"}]).write(responses(spark))
    assert spark.read.parquet(f"{tmp_path}/y").count() == 2
    with pytest.raises(sinks.SinkError):
        sinks.Sink("json", f"{tmp_path}/j.json", "error").write(responses(spark))


def test_outputs(spark):
    n, asked, setup = network(spark, SQUARE, [(0, 0), (1, 0), (1, 1), (0, 1)]), requests(spark, [(0, 1), (0, 0), (2, 3)]), kilometres()
    tree = relax(n, asked.withColumn("destination", F.lit(None).cast("long")), setup)
    assert labels_at(tree, spark.createDataFrame([(1,)], "vertex_id long")).count() == 3
    assert [r.vertex_id for r in parents(tree, spark.createDataFrame([(0, 3, 0)], "query_id long, vertex_id long, bin int")).collect()] == [0]
    way = routes(tree, asked)
    made = output.path_summary(way, setup.features, {"edge_distance": "max"}).orderBy("query_id").collect()
    assert [(r.query_id, round(r.trip_distance * 1.609344, 6), round(r.edge_distance * 1.609344, 6), r.n_edges) for r in made] == [(0, 5, 2, 3), (2, 1, 1, 1)]
    for how, want in (("avg", 5 / 3), ("first", 2), ("last", 2), ("min", 1), ("sum", 5)):
        assert output.path_summary(way, setup.features, {"edge_distance": how}).filter("query_id = 0").first().edge_distance * 1.609344 == pytest.approx(want)
    lines = n.straight_lines()
    form = lambda f: {r.query_id: r.route for r in output.route_output(way, f, setup.features, lines).collect()}
    assert form("wkt")[2] == "LINESTRING (1.0 1.0, 0.0 1.0)" and form("wkb")[2].startswith("0102000000") and [e["edge_id"] for e in json.loads(form("edge_id")[0])] == [7, 5, 3]
    assert json.loads(form("geo_json")[0])["features"][0]["properties"]["edge_id"] == 7 and json.loads(form("json")[0])[0]["result_state"]["trip_distance"] > 0
    wkb = {r.query_id: r.tree for r in output.tree_output(tree, "wkb", setup.features, lines).collect()}
    assert all(t.startswith("010500000003000000" + "0102000000") for t in wkb.values())
    for f in ("wkt", "wkb", "json", "geo_json", "edge_id", "multipoint"):
        assert output.tree_output(tree, f, setup.features, lines).count() == 3
    features = sinks.tree_features(output.responses(asked.withColumn("request", F.lit("{}")).withColumn("error", F.lit(None).cast("string")).select("query_id", "request", "error"), output.tree_output(tree, "geo_json", setup.features, lines).withColumn("tree", F.from_json("tree", "type string, features array<struct<type:string,properties:struct<edge_id:long>>>"))))
    assert features.count() > 0
    assert {r.query_id: (r.tree_size > 0, r.route_edges, r.n_routes) for r in output.run_summary(tree, way, asked).collect()}[0] == (True, 3, 1)
    many = spark.createDataFrame([(0, 0, '"a"'), (0, 1, '"b"'), (1, 0, '"c"')], "query_id long, route_idx int, route string")
    assert {r.query_id: json.loads(r.route) for r in output.by_cardinality(many).collect()} == {0: ["a", "b"], 1: "c"}
    uuids = spark.createDataFrame([(0, "u0"), (1, "u1")], "vertex_id long, uuid string")
    assert {(r.origin_uuid, r.destination_uuid) for r in output.with_uuids(asked, uuids).collect()} == {("u0", "u1"), ("u0", "u0"), (None, None)}
    nested = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("c")).alias("b")).alias("a"), "id")
    assert sinks.flattened(nested).columns == ["a.b.c", "id"]


def test_dataset(spark, tmp_path):
    nodes = spark.createDataFrame([(100, 0.0, 0.0), (50, 1.0, 0.0), (70, 1.0, 1.0)], "osmid long, x double, y double")
    v = dataset.vertices_of(nodes)
    assert {r.osmid: r.vertex_id for r in v.collect()} == {50: 0, 70: 1, 100: 2}
    line = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    links = spark.createDataFrame([(100, 50, 0, 10.0, "a", 30.0, line), (100, 50, 1, 9.0, "a", 99.0, line), (50, 70, 0, 20.0, "a", None, line), (70, 100, 0, 0.0, "b", None, line)], "u long, v long, key int, length double, highway string, maxspeed_kph double, line array<struct<x:float,y:float>>")
    e = dataset.headings(dataset.grades(dataset.imputed_speeds(dataset.edges_of(links, v)), spark.createDataFrame([(0, 5.0), (1, 9.0), (2, 0.0)], "vertex_id long, elevation_m double")))
    rows = e.orderBy("edge_id").collect()
    assert [(r.edge_id, r.src_vertex_id, r.dst_vertex_id, r.speed_kph, r.grade) for r in rows] == [(0, 0, 1, 30.0, 0.2), (1, 1, 2, 30.0, 0.0), (2, 2, 0, 30.0, 0.5)]
    assert (rows[0].arrival_heading, rows[0].departure_heading) == (90, 0)
    dataset.write_dataset(v, e, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/edges").count() == 3
    sites = spark.createDataFrame([(1.0, 2.0, 1, None, 3, "$0.20/kWh"), (1.0, 2.0, 0, 0, 0, None)], "longitude double, latitude double, ev_level1_num int, ev_level2_num int, ev_dc_fast_num int, ev_pricing string")
    assert sorted((r.power_type, r.power_kw, r.cost_per_kwh) for r in dataset.station_rows(sites).collect()) == [("DCFC", 150.0, 0.2), ("L1", 1.8, 0.2)]
    tiles = dataset.elevation_tiles(spark.createDataFrame([(-104.5, 39.5), (-104.6, 39.1)], "x double, y double"))
    assert [r.tile for r in tiles.collect()] == ["n40w105"]
    with pytest.raises(Exception, match="tiles"):
        dataset.elevation_tiles(spark.createDataFrame([(4.5, 39.5)], "x double, y double")).collect()


def test_lines_of_a_folder_are_in_the_order_of_its_files(spark, tmp_path):
    numbers = [(i * 37) % 64 for i in range(64)]
    for i in numbers:
        (tmp_path / f"part-{i:05d}.txt").write_text("".join(f"{i * 3 + k}\n" for k in range(3)) if i != 5 else "")
    want = [str(i * 3 + k) for i in range(64) if i != 5 for k in range(3)]
    assert [(r.row, r.value) for r in files.read_lines(spark, str(tmp_path)).orderBy("row").collect()] == list(enumerate(want))
