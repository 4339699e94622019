import json

import pytest
from pyspark.sql import functions as F

from tests.networks import network
from wayfold.operators import matching, shaping
from wayfold.sources.derived import derived_network


def rows_of(spark, texts):
    return shaping.requests_of(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, request string"))


def test_bins_keep_every_row(spark):
    rows = spark.createDataFrame([(0, '{"w": 3}'), (0, '{"w": 1}'), (None, '{"w": 5}'), (0, '{"w": 3}')], "query_id long, request string")
    made = shaping.with_bins(shaping.weight_numeric(shaping.requests_of(rows), "w"), 2)
    assert sorted(r.request for r in made.collect()) == sorted(['{"w": 3}', '{"w": 1}', '{"w": 5}', '{"w": 3}'])
    many = spark.range(1000).selectExpr("id AS query_id", "concat('{\"w\": ', id % 7, '}') AS request")
    weighed = shaping.weight_numeric(shaping.requests_of(many), "w")
    sums = [r[1] for r in shaping.with_bins(weighed, 4, group=100).groupBy("bin").sum("query_weight_estimate").collect()]
    assert len(sums) == 4 and max(sums) - min(sums) < 40


def test_grid_search(spark):
    texts = [json.dumps(x) for x in ({"a": 1, "grid_search": {"bar": ["a", "b", "c"], "foo": [1.2, 3.4], "skip": 7}}, {"a": 2}, {"grid_search": {"x": [{"p": 1, "q": 2}, {"p": 3}]}}, {"grid_search": {"x": [{"grid_search": {}}]}})]
    got = shaping.grid_search(rows_of(spark, [*texts, "{bad"])).orderBy("query_id", "combo_idx").collect()
    one = [json.loads(r.request) for r in got if r.query_id == 0]
    assert [(x["bar"], x["foo"]) for x in one] == [("a", 1.2), ("b", 1.2), ("c", 1.2), ("a", 3.4), ("b", 3.4), ("c", 3.4)] and all(x["a"] == 1 and "grid_search" not in x for x in one)
    assert [json.loads(r.request) for r in got if r.query_id == 2] == [{"p": 1, "q": 2}, {"p": 3}]
    assert [r.error is None for r in got if r.query_id in (1, 3, 4)] == [True, False, False]
    assert list(shaping.product([[1, 3], [2], [5, 7, 9]])) == [(1, 2, 5), (3, 2, 5), (1, 2, 7), (3, 2, 7), (1, 2, 9), (3, 2, 9)]


def test_grid_of_columns(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1, 2, 3])], "id int, bars array<string>, foos array<int>")
    got = shaping.grid_columns(df, {"bars": "bar", "foos": "foo"}).orderBy("combo_idx").collect()
    assert [(r.combo_idx, r.bar, r.foo) for r in got] == [(0, "a", 1), (1, "b", 1), (2, "a", 2), (3, "b", 2), (4, "a", 3), (5, "b", 3)]


def test_injection(spark):
    base = rows_of(spark, [json.dumps({"o": {"foo": "bar"}, "l": ["test"], "n": 1})])
    value = lambda df, key: json.loads(df.first().request)[key]
    assert value(shaping.inject_constant(base, "o", {"baz": "bees"}, "append"), "o") == {"foo": "bar", "baz": "bees"}
    assert value(shaping.inject_constant(base, "l", [5, 3.14159], "append"), "l") == ["test", 5, 3.14159]
    assert value(shaping.inject_constant(base, "l", [0, 0, 0, 0]), "l") == [0, 0, 0, 0]
    assert value(shaping.inject_constant(base, "n", 9, "ignore"), "n") == 1 and value(shaping.inject_constant(base, "m", 9, "ignore"), "m") == 9
    for key, mode in (("n", "append"), ("n", "fail_if_existing")):
        assert shaping.inject_constant(base, key, 9, mode).first().error
    with pytest.raises(ValueError):
        shaping.inject_constant(base, "n", 9, "odd")


def test_injection_by_polygon(spark):
    ring = [(-105.2, 39.8), (-105.1, 39.8), (-105.1, 39.9), (-105.2, 39.9)]
    polygons = spark.createDataFrame([(1, "6000", ring), (0, "5000", ring)], "order int, value string, ring array<struct<x:double,y:double>>")
    base = rows_of(spark, [json.dumps({"origin_x": x, "origin_y": y}) for x, y in ((-105.11011, 39.83906), (-105.07022, 39.93602))])
    fee = lambda df: [json.loads(r.request).get("fee") for r in df.orderBy("query_id").collect()]
    assert fee(shaping.inject_by_polygon(base, polygons, "fee")) == [5000, None]
    assert fee(shaping.inject_by_polygon(base, polygons, "fee", default=7)) == [5000, 7]


@pytest.mark.parametrize(("weights", "want"), [([1] * 12, [[0, 4, 8], [1, 5, 9], [2, 6, 10], [3, 7, 11]]), ([1, 4, 1, 2] * 3, [[0, 4, 6, 8, 9], [1, 10], [2, 5], [3, 7, 11]]), ([4] + [1] * 11, [[0], [1, 4, 7, 10], [2, 5, 8, 11], [3, 6, 9]])])
def test_balancing(weights, want):
    assert shaping.balance(weights, 4) == want


def test_weights(spark):
    base = rows_of(spark, [json.dumps(x) for x in ({"origin_x": 0, "origin_y": 0, "destination_x": 0, "destination_y": 1, "w": 3, "c": "a"}, {"c": "b"})])
    got = lambda df: [(r.query_weight_estimate, r.error is None) for r in df.orderBy("query_id").collect()]
    (km, ok), (none, bad) = got(shaping.weight_haversine(base))
    assert km == pytest.approx(111.195, abs=1e-2) and ok and none is None and not bad
    assert got(shaping.weight_numeric(base, "w")) == [(3.0, True), (None, False)]
    assert got(shaping.weight_categorical(base, "c", {"a": 2.0})) == [(2.0, True), (None, False)]
    assert got(shaping.weight_categorical(base, "c", {"a": 2.0}, 1.0)) == [(2.0, True), (1.0, True)]
    assert {r.query_id: r.bin for r in shaping.with_bins(shaping.weight_numeric(base, "w"), 2).collect()} == {0: 0, 1: 1}


def test_plugins_split_errors(spark):
    said = []
    good, bad = shaping.run_plugins(rows_of(spark, ['{"error": "a user key", "w": 1}', "{bad"]), [lambda df: shaping.debug(df, said.append), lambda df: shaping.inject_constant(df, "x", 1)])
    assert [r.query_id for r in good.collect()] == [0] and [r.query_id for r in bad.collect()] == [1] and len(said) == 2


def test_maps_and_state_overrides(spark):
    df = spark.createDataFrame([({"b": 9.0, "c": 3.0},), (None,)], "m map<string,double>")
    assert [r[0] for r in df.select(shaping.merged_map({"a": 1.0, "b": 2.0}, F.col("m"))).collect()] == [{"a": 1.0, "b": 9.0, "c": 3.0}, {"a": 1.0, "b": 2.0}]
    known = {"trip_distance": "distance"}
    assert shaping.state_overrides({"state_features": {"trip_distance": {"type": "distance", "initial": 4}}}, known) == {"trip_distance": 4.0}
    for bad in ({"x": 1}, {"trip_distance": {"type": "time", "initial": 1}}, {"trip_distance": "a"}):
        with pytest.raises(ValueError):
            shaping.state_overrides({"state_features": bad}, known)


def points(spark, rows):
    return spark.createDataFrame(rows, "point_id long, x double, y double")


def test_nearest_vertex(spark):
    n = network(spark, [(0, 1, 1), (1, 2, 1)], [(0, 0), (1, 1), (2, 2)])
    got = {r.point_id: r.vertex_id for r in matching.nearest_vertex(points(spark, [(0, 0.101, 0.101), (1, 1.901, 2.101), (2, 90.0, 80.0), (3, 0.5, 0.5)]), n).collect()}
    assert got == {0: 0, 1: 2, 2: 2, 3: 0}
    n.vertices = n.vertices.limit(0)
    none = matching.nearest_vertex(points(spark, [(0, 0.1, 0.1)]), n)
    assert none.columns == ["point_id", "vertex_id", "d2"] and none.count() == 0


def test_nearest_against_brute_force(spark):
    n = derived_network(spark, "/root/testdata/sf0.001")
    vertices = [(r.vertex_id, r.x, r.y) for r in n.vertices.collect()]
    asked = [(i, -105.3 + (i * 37 % 101) / 60, 38.8 + (i * 53 % 97) / 60) for i in range(60)]
    for size in (None, 0.01, 5.0):
        got = {r.point_id: (r.vertex_id, r.d2) for r in matching.nearest_vertex(points(spark, asked), n, size).collect()}
        for i, x, y in asked:
            d2, v = min(((vx - x) ** 2 + (vy - y) ** 2, v) for v, vx, vy in vertices)
            assert got[i][0] == v and got[i][1] == pytest.approx(d2)


def test_matching_needs_valid_edges(spark):
    n = network(spark, [(0, 1, 1)], [(0, 0), (0.001, 0), (5, 5)])
    n.vertices = n.vertices.union(spark.createDataFrame([(2, 0.0005, 0.0)], "vertex_id long, x float, y float"))
    at = points(spark, [(0, 0.0006, 0.0), (1, 3.0, 0.0)])
    got = lambda side, **k: {r.point_id: (r.vertex_id, r.error is None) for r in matching.match_by_point(at, n, side, **k).collect()}
    assert got("origin")[0] == (0, True) and got("destination")[0] == (1, True)
    assert got("origin", tolerance=200.0) == {0: (0, True), 1: (None, False)}
    assert got("origin", tolerance=200.0, compat_tolerance=True) == {0: (None, False), 1: (0, True)}


def test_requests_are_matched_in_order(spark):
    n = network(spark, [(0, 1, 1), (1, 2, 1)], [(0, 0), (1, 0), (2, 0)])
    schema = "query_id long, " + ", ".join(f"{s}_x double, {s}_y double, {s}_vertex long, {s}_edge_list int, {s}_edge long" for s in ("origin", "destination"))
    rows = [(0, 0.1, 0.0, None, None, None, 1.9, 0.0, None, None, None), (1, None, None, 1, None, None, None, None, 2, None, None), (2, None, None, None, 0, 0, None, None, None, 0, 1), (3, None, None, 2, None, None, None, None, None, None, None), (4, *[None] * 10)]
    got = {r.query_id: (r.origin, r.destination, r.error) for r in matching.match_requests(spark.createDataFrame(rows, schema), n).collect()}
    assert got[0] == (0, 2, None) and got[1] == (1, 2, None) and got[2] == (1, 1, None)
    assert got[3][2] == "vertex cannot be a origin" and got[4][2] == "no origin"
    strict = {r.query_id: r.error for r in matching.match_requests(spark.createDataFrame(rows[:1] + [(5, 0.1, 0.0, *[None] * 8)], schema), n, destination_required=True).collect()}
    assert strict == {0: None, 5: "no destination"}


def test_lines_keep_their_rows(spark):
    lines = network(spark, [(0, 1, 1), (1, 2, 1)], [(0, 0), (1, 0), (2, 0)]).straight_lines()
    asked = spark.createDataFrame([(0, 0, 1), (1, 0, 9), (2, 0, 1)], "row int, edge_list_id int, edge_id long")
    assert [r.line is not None for r in matching.lines_of(asked, lines).orderBy("row").collect()] == [True, False, True]


def test_boxes_in_one_place_are_one(spark, monkeypatch):
    made, plain = {}, matching.materialise
    monkeypatch.setattr(matching, "materialise", lambda df, tag, *more: made.setdefault(tag, plain(df, tag, *more)) if tag == "cells" else plain(df, tag, *more))
    vertices = spark.range(600).selectExpr("id AS vertex_id", "CAST(id % 3 AS DOUBLE) AS x", "CAST(id % 2 AS DOUBLE) AS y")
    boxes = matching.vertex_boxes(vertices.orderBy("vertex_id", ascending=False))
    got = matching.nearest(points(spark, [(0, 0.1, 0.1), (1, 2.2, 0.9), (2, 1.0, 1.0)]), boxes, ["vertex_id"])
    assert {r.point_id: r.vertex_id for r in got.collect()} == {0: 0, 1: 5, 2: 1}
    assert made["cells"].count() == 6


def test_cells_keep_only_the_boxes_that_may_be_answers(spark, monkeypatch):
    import random

    draw, made = random.Random(5), {}
    boxes = [(i, *sorted(draw.uniform(0, 1) for _ in range(2)), *sorted(draw.uniform(0, 1) for _ in range(2))) for i in range(600)]
    points = [(k, draw.uniform(-0.3, 1.3), draw.uniform(-0.3, 1.3)) for k in range(300)]
    monkeypatch.setattr(matching, "materialise", lambda df, tag, *more: made.setdefault(tag, df.localCheckpoint()) if tag == "cells" else df.localCheckpoint())
    frame = spark.createDataFrame([(i, x0, y0, x1, y1) for i, x0, x1, y0, y1 in boxes], "k int, x0 double, y0 double, x1 double, y1 double")
    got = matching.nearest(spark.createDataFrame(points, "point_id int, x double, y double"), frame, ["k"])
    far = lambda lo, v, hi: max(lo - v, 0.0, v - hi)
    want = {k: min((far(x0, x, x1) ** 2 + far(y0, y, y1) ** 2, i) for i, x0, x1, y0, y1 in boxes)[1] for k, x, y in points}
    assert {r.point_id: r.k for r in got.collect()} == want
    made.clear()
    whole = spark.createDataFrame([(-1, 0.0, 0.0, 1.0, 1.0)], frame.schema)
    assert {r.k for r in matching.nearest(spark.createDataFrame([(0, 0.5, 0.5)], "point_id int, x double, y double"), frame.unionByName(whole), ["k"]).collect()} == {-1}
    assert made["cells"].count() < len(boxes)
