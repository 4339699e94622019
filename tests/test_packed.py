"""Searches over packed arrays against the relational rounds."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators.cost import CostModel, Rate
from wayfold.operators.graph import Network
from wayfold.operators.models import Custom, Distance, Speed, Time, TurnDelay
from wayfold.plans import packed, search
from wayfold.plans.search import Setup, kernel, least_costs, trees
from tests.networks import SQUARE, kilometres, network, requests

COLUMNS = ["query_id", "vertex_id", "label", "g", "objective_cost", "total_cost", "edge_list_id", "edge_id", "parent_vertex", "parent_label", "depth"]


def random_rows(seed, n=40, degree=4):
    r = random.Random(seed)
    return [(i, r.randrange(n), r.randrange(1, 6)) for i in range(n) for _ in range(degree)] + [(i, i + 1, 3) for i in range(n - 1)]


def rows_of(tree):
    state = [F.round(f"state.{c}", 9).alias(c) for c in tree.schema["state"].dataType.names]  # sums may be added in another order
    return sorted(map(str, tree.select(*COLUMNS, *state).collect()))


def both(monkeypatch, find):
    """What the packed arrays give, and what the rounds give."""
    calls, real = [], search.searched
    monkeypatch.setattr(search, "searched", lambda *a: calls.append(real(*a)) or calls[-1])
    found = find()
    assert calls and all(c is not None for c in calls)
    monkeypatch.setattr(search, "searched", lambda *a: None)
    return found, find()


@pytest.mark.parametrize("direction", ["forward", "reverse"])
def test_trees_are_those_of_the_rounds(spark, monkeypatch, direction):
    net = network(spark, random_rows(1))
    asked = requests(spark, [(0, None), (7, None), (39, None), (99, None)])
    a, b = both(monkeypatch, lambda: rows_of(trees(net, asked, kilometres(direction=direction))))
    assert a == b and len(a) > 80


def test_trees_with_weights_and_cut_edges_are_those_of_the_rounds(spark, monkeypatch):
    net = network(spark, random_rows(2))
    setup = Setup([Distance(), Custom("metres", "distance_m", accumulator=True)], CostModel({}, {"trip_distance": Rate("raw"), "metres": Rate("raw", 0.001)}, own_weights=True), initial={"metres": 5.0})
    own = requests(spark, [(0, None), (3, None), (5, None)]).withColumn("weights", F.when(F.col("query_id") == 2, F.create_map(F.lit("trip_distance"), F.lit(1.0))).otherwise(F.create_map(F.lit("metres"), 1.0 + F.col("query_id"), F.lit("trip_distance"), F.lit(0.5))))
    cut = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (1, 0, 12), (2, 0, 20)], "query_id long, edge_list_id int, edge_id long")
    a, b = both(monkeypatch, lambda: rows_of(trees(net, own, setup, cut)))
    assert a == b and len(a) > 80


@pytest.mark.parametrize("seed", [3, 4])
def test_trees_with_turn_delays_are_those_of_the_rounds(spark, monkeypatch, seed):
    rows = random_rows(seed, 15, 3)
    plain = network(spark, rows, more=[(30.0,)] * len(rows))
    heading = lambda k: (F.col("edge_id") * k % 360).cast("int")
    edges = plain.edges.withColumn("arrival_heading", heading(37)).withColumn("departure_heading", F.when(F.col("edge_id") % 5 > 0, heading(53)))
    delays = dict.fromkeys(("no_turn", "slight_left", "slight_right", "sharp_left", "sharp_right"), 0.0) | {"left": 30.0, "right": 10.0, "u_turn": 60.0}
    setup = Setup([Distance(), Speed(), Time(), TurnDelay(delays)], CostModel({"trip_time": 1.0}, {"trip_time": Rate("raw")}))
    asked = requests(spark, [(0, None), (4, None)])
    a, b = both(monkeypatch, lambda: sorted(map(tuple, trees(Network(plain.vertices, edges), asked, setup).select("query_id", "vertex_id", "label", F.round("g", 9), "depth").collect())))
    assert a == b and len(a) > 30


def test_the_best_ways_alone(spark):
    net, asked = network(spark, random_rows(5)), requests(spark, [(0, 39), (7, 7), (39, 2), (3, 99)])
    whole, ways = trees(net, asked, kilometres()), trees(net, asked, kilometres(), ways=True)
    ends = ["query_id", "vertex_id"]
    goals = asked.select("query_id", F.col("destination").alias("vertex_id"))
    assert sorted(map(str, ways.join(goals, ends).collect())) == sorted(map(str, whole.join(goals, ends).collect()))
    assert set(rows_of(ways)) < set(rows_of(whole))


def test_a_long_way_needs_no_table_a_round(spark, monkeypatch):
    written, real = [], search.materialise
    for module in (search, packed):
        monkeypatch.setattr(module, "materialise", lambda df, tag, *a: written.append(tag) or real(df, tag, *a))
    net = network(spark, [(i, i + 1, 1) for i in range(60)])
    g = {r["vertex_id"]: r["g"] for r in least_costs(net, requests(spark, [(0, None)]), kilometres()).collect()}
    assert g == {i: float(i) for i in range(61)}
    assert len(written) < 10


def test_arrays_that_would_be_too_large_are_not_made(spark, monkeypatch):
    net, asked = network(spark, SQUARE), requests(spark, [(0, None)])
    few = rows_of(trees(net, asked, kilometres()))
    monkeypatch.setattr(packed, "ARRAY_BYTES", 100)
    assert rows_of(trees(net, asked, kilometres())) == few


def test_requests_share_few_copies(spark, monkeypatch):
    net, asked = network(spark, random_rows(6)), requests(spark, [(i, None) for i in range(20)])
    many = rows_of(trees(net, asked, kilometres()))
    monkeypatch.setattr(packed, "COPIED", 500)
    monkeypatch.setattr(packed, "BLOCK", 20)
    monkeypatch.setattr(packed, "CHUNK", 7)
    assert rows_of(trees(net, asked, kilometres())) == many


def test_a_kernel_above_its_size_is_answered_by_rounds(spark):
    net, asked = network(spark, SQUARE), requests(spark, [(0, None)])
    g = {r["vertex_id"]: r["g"] for r in kernel(net, asked, kilometres(), most=100).collect()}
    assert g == {r["vertex_id"]: r["g"] for r in kernel(net, asked, kilometres()).collect()}
