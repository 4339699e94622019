import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.networks import CROSS, SQUARE, kilometres, network, requests
from wayfold.operators import constraints
from wayfold.operators.cost import CostModel, Rate
from wayfold.operators.graph import Network, NetworkError, largest_component, strong_components
from wayfold.operators.labels import SocBins
from wayfold.operators.models import Custom, Distance, Speed, Time, TurnDelay
from wayfold.plans import ksp
from wayfold.plans.paths import backtrack, edge_lists, has_loop, routes
from wayfold.plans.search import Limits, SearchError, Setup, answered, relax, search


def found(tree, asked):
    return {r.query_id: (r.edges, round(r.objective_cost, 6)) for r in edge_lists(routes(tree, asked)).collect()}


def dijkstra(rows, start):
    best, queue = {start: 0}, [(0, start)]
    while queue:
        g, v = heapq.heappop(queue)
        if g > best[v]:
            continue
        for s, d, k in rows:
            if s == v and g + k < best.get(d, 1e18):
                best[d] = g + k
                heapq.heappush(queue, (g + k, d))
    return best


@pytest.mark.parametrize("engine", ["relax", "kernel"])
def test_square(spark, engine):
    asked = requests(spark, [(0, 1), (0, 3), (1, 0), (1, 2), (2, 3), (0, 0)])
    got = found(search(network(spark, SQUARE), asked, kilometres(), engine), asked)
    assert got == {0: ([7, 5, 3], 5), 1: ([7], 2), 2: ([2, 4, 6], 5), 3: ([2], 2), 4: ([4], 1)}


def test_cross_with_a_heuristic(spark):
    places = [(0, 0), (0, -0.01), (-0.01, 0), (0, 0.01), (0.01, 0), (0.02, 0)]
    rows = [(s, d, 1.2) for s, d, _ in CROSS]
    asked = requests(spark, [(0, 5)])
    got = found(search(network(spark, rows, places), asked, kilometres(heuristic=True), "kernel"), asked)
    assert got[0][0] == [6, 8]


def test_time_and_distance_disagree(spark):
    rows = [(0, 1, 175.381), (0, 2, 772.32), (1, 2, 707.96)]
    n = network(spark, rows, more=[(112.0,), (64.36,), (112.0,)])
    asked = requests(spark, [(0, 2)])
    models = lambda: [Distance(), Speed(), Time()]
    fast = Setup(models(), CostModel({"trip_time": 1.0, "trip_distance": 0.0}, {"trip_time": Rate(), "trip_distance": Rate()}))
    short = Setup(models(), CostModel({"trip_distance": 1.0}, {"trip_distance": Rate()}))
    edges, minutes = found(search(n, asked, fast), asked)[0]
    assert edges == [0, 2] and minutes == pytest.approx(473.2, abs=0.1)
    assert found(search(n, asked, short), asked)[0][0] == [1]


def random_rows(seed, n=14, m=50):
    r = random.Random(seed)
    return [(s, d, r.randint(1, 9)) for s, d in {(r.randrange(n), r.randrange(n)) for _ in range(m)} if s != d]


@pytest.mark.parametrize("seed", range(3))
def test_engines_agree_with_dijkstra_and_trees_are_consistent(spark, seed):
    rows = random_rows(seed)
    n = network(spark, rows)
    asked = requests(spark, [(0, None), (3, None)])
    for engine in ("relax", "kernel"):
        tree = search(n, asked, kilometres(), engine).collect()
        for q, start in ((0, 0), (1, 3)):
            assert {r.vertex_id: round(r.g, 6) for r in tree if r.query_id == q} == dijkstra(rows, start)
        at = {(r.query_id, r.vertex_id): r for r in tree}
        for r in tree:
            if r.edge_id is not None:
                parent = at[r.query_id, r.parent_vertex]
                assert r.g == pytest.approx(parent.g + r.objective_cost) and r.depth == parent.depth + 1
    back = relax(n, asked, kilometres(direction="reverse")).collect()
    flipped = dijkstra([(d, s, k) for s, d, k in rows], 3)
    assert {r.vertex_id: round(r.g, 6) for r in back if r.query_id == 1} == flipped


def test_limits(spark):
    n = network(spark, [(i, i + 1, 1) for i in range(20)])
    asked = requests(spark, [(0, 20)])
    with pytest.raises(SearchError):
        relax(n, asked, kilometres(limits=Limits(rounds=3)))
    tree = relax(n, requests(spark, [(0, None)]), kilometres(limits=Limits(rounds=3)))
    assert tree.count() == 4
    assert Limits.of({"type": "combined", "models": [{"type": "iterations", "limit": 5}, {"type": "query_runtime", "limit": "00:01:30"}]}).seconds == 90
    assert Limits(rounds=2, labels=9).reached(2, 3, 0.0) == "2 of 2 iterations"


def test_backtracking_to_a_depth(spark):
    n = network(spark, [(i, i + 1, 1) for i in range(6)])
    tree = relax(n, requests(spark, [(0, None)]), kilometres())
    target = spark.createDataFrame([(0, 6)], "query_id long, vertex_id long")
    assert [r.edge_id for r in backtrack(tree, target, 2).orderBy("pos").collect()] == [4, 5]
    assert [r.edge_id for r in backtrack(tree, target).orderBy("pos").collect()] == list(range(6))


def test_constraints(spark):
    n = network(spark, SQUARE)
    classed = Network(n.vertices, n.edges.withColumn("road_class", F.when(F.col("edge_id") == 7, "b").otherwise("a")))
    asked = requests(spark, [(0, 3)])
    assert found(search(classed, asked, kilometres(constraint=constraints.RoadClass(["a"]))), asked)[0] == ([0, 2, 4], 13)
    with pytest.raises(constraints.ConstraintError):
        constraints.RoadClass(["zz"]).prefilter(classed.edges)
    pairs = spark.createDataFrame([(5, 3)], "prev_edge_id long, next_edge_id long")
    turn = constraints.TurnRestriction(pairs)
    both = requests(spark, [(0, 1)])
    for engine in ("kernel", "relax"):
        assert found(search(n, both, kilometres(constraint=turn), engine), both)[0] == ([0], 10)


def test_vehicle_restrictions(spark):
    rows = spark.createDataFrame([(0, "maximum_total_weight", 65000.0, "<", "lbs"), (0, "maximum_height", 13.0, "<", "feet"), (1, "maximum_height", 99.0, "<", "feet"), (1, "maximum_height", 9.0, "<", "feet")], "edge_id long, name string, value double, operation string, unit string")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    limits = constraints.normalised_restrictions(rows, "row")
    edges = spark.createDataFrame([(0,), (1,), (2,)], "edge_id long")
    ok = lambda p: sorted(r[0] for r in constraints.VehicleRestriction(limits, p).prefilter(edges).collect())
    assert ok([("height", 10.0, "ft"), ("total_weight", 50000.0, "lbs")]) == [0, 2]
    assert ok([("height", 15.0, "ft"), ("total_weight", 50000.0, "lbs")]) == [2]
    assert ok([("height", 8.0, "ft"), ("total_weight", 35.0, "tons")]) == [1, 2]
    assert ok([("width", 99.0, "ft")]) == [0, 1, 2] and ok([]) == [0, 1, 2]
    with pytest.raises(constraints.ConstraintError):
        ok(None)


def test_turn_delays_change_the_way(spark):
    n = network(spark, [(0, 1, 1), (1, 3, 1), (0, 2, 1.1), (2, 3, 1.1)], more=[(60.0,)] * 4)
    e = n.edges.withColumn("arrival_heading", F.element_at(F.array(*map(F.lit, (0, 90, 0, 0))), (F.col("edge_id") + 1).cast("int"))).withColumn("departure_heading", F.col("arrival_heading"))
    asked = requests(spark, [(0, 3)])
    delays = dict.fromkeys(("no_turn", "slight_left", "slight_right", "left", "sharp_left", "sharp_right", "u_turn"), 0.0) | {"right": 30.0}
    setup = Setup([Distance(), Speed(), Time(), TurnDelay(delays)], CostModel({"trip_time": 1.0}, {"trip_time": Rate()}))
    assert setup.history
    for engine in ("kernel", "relax"):
        edges, minutes = found(search(Network(n.vertices, e), asked, setup, engine), asked)[0]
        assert edges == [2, 3] and minutes == pytest.approx(2.2)


def dijkstra_by_edges(rows, headings, delays, start, forbidden=()):
    """Least minutes to each vertex where the delay of a turn depends on the edge before: a label for each edge."""
    best, queue, done = {}, [(0.0, -1, start)], {start: 0.0}
    while queue:
        g, before, v = heapq.heappop(queue)
        if best.get(before, 1e18) < g:
            continue
        for i, (s, d, k) in enumerate(rows):
            if s != v or (before, i) in forbidden:
                continue
            cost = k
            if before >= 0:
                angle = headings[i] - headings[before]
                angle = angle - 360 if angle > 180 else angle + 360 if angle < -180 else angle
                side, size = ("left" if angle < 0 else "right"), abs(angle)
                turn = "no_turn" if size <= 19 else f"slight_{side}" if size <= 44 else side if size <= 134 else f"sharp_{side}" if size <= 159 else "u_turn"
                cost += delays[turn] / 60
            if g + cost < best.get(i, 1e18) - 1e-12:
                best[i] = g + cost
                done[d] = min(done.get(d, 1e18), g + cost)
                heapq.heappush(queue, (g + cost, i, d))
    return done


@pytest.mark.parametrize("seed", [4, 5])
def test_turns_against_a_search_by_edges(spark, seed):
    r = random.Random(seed)
    rows = random_rows(seed, 10, 40)
    headings = [r.randrange(360) for _ in rows]
    delays = {k: float(r.randrange(0, 400)) for k in ("no_turn", "slight_left", "slight_right", "left", "right", "sharp_left", "sharp_right", "u_turn")}
    n = network(spark, rows, more=[(60.0,)] * len(rows))
    e = n.edges.join(spark.createDataFrame(list(enumerate(headings)), "edge_id long, arrival_heading int"), "edge_id").withColumn("departure_heading", F.col("arrival_heading"))
    forbidden = {(i, j) for i, (_, d, _) in enumerate(rows) for j, (s, _, _) in enumerate(rows) if d == s and r.random() < 0.2}
    pairs = spark.createDataFrame(sorted(forbidden), "prev_edge_id long, next_edge_id long")
    setup = Setup([Distance(), Speed(), Time(), TurnDelay(delays)], CostModel({"trip_time": 1.0}, {"trip_time": Rate()}), constraint=constraints.TurnRestriction(pairs))
    asked = requests(spark, [(0, None), (3, None)])
    tree = search(Network(n.vertices, e), asked, setup)
    got = {}
    for row in tree.collect():
        got[row.query_id, row.vertex_id] = min(got.get((row.query_id, row.vertex_id), 1e18), row.g)
        assert row.state.trip_time == pytest.approx(row.g, abs=1e-6)
    for q, start in ((0, 0), (1, 3)):
        want = dijkstra_by_edges(rows, headings, delays, start, forbidden)
        assert {v: round(g, 6) for (k, v), g in got.items() if k == q} == {v: round(g, 6) for v, g in want.items()}
    goals = requests(spark, [(0, v) for v in range(10)])
    way = edge_lists(routes(search(Network(n.vertices, e), goals, setup), goals))
    assert {row.query_id: round(row.objective_cost, 6) for row in way.collect()} == {v: round(g, 6) for v, g in dijkstra_by_edges(rows, headings, delays, 0, forbidden).items() if v != 0}


def test_labels_where_turns_are_only_delayed_are_headings(spark):
    """Four edges that arrive at a vertex by one heading are one label; a second heading is another."""
    rows = [(0, 1, 4), (0, 1, 3), (0, 1, 2), (0, 1, 2), (0, 1, 5), (1, 2, 1)]
    n = network(spark, rows, more=[(60.0,)] * len(rows))
    e = n.edges.withColumn("arrival_heading", F.when(F.col("edge_id") == 4, 90).otherwise(0)).withColumn("departure_heading", F.col("arrival_heading"))
    delays = dict.fromkeys(("no_turn", "slight_left", "slight_right", "left", "right", "sharp_left", "sharp_right", "u_turn"), 60.0)
    setup = Setup([Distance(), Speed(), Time(), TurnDelay(delays)], CostModel({"trip_time": 1.0}, {"trip_time": Rate()}))
    tree = search(Network(n.vertices, e), requests(spark, [(0, None)]), setup).collect()
    assert sorted((r.vertex_id, round(r.g, 6), r.edge_id) for r in tree if r.edge_id is not None) == [(1, 2, 2), (1, 5, 4), (2, 4, 5)]


def test_requests_with_weights_of_their_own_equal_single_runs(spark):
    rows = random_rows(7, 9, 30)
    n = network(spark, rows, more=[(20.0 + 10 * (i % 7),) for i in range(len(rows))])
    models, rates = lambda: [Distance(), Speed(), Time()], {"trip_distance": Rate(), "trip_time": Rate("time", 2.0, "minutes")}
    given = [{"trip_distance": 1.0}, {"trip_time": 1.0}, {"trip_distance": 3.0, "trip_time": 0.25}, {"trip_distance": 0.0, "trip_time": 2.0}]
    asked = requests(spark, [(0, None)] * 4)
    batch = asked.join(spark.createDataFrame([(i, w) for i, w in enumerate(given)], "query_id long, weights map<string,double>"), "query_id")
    tree = relax(n, batch, Setup(models(), CostModel({}, rates, own_weights=True))).collect()
    for i, w in enumerate(given):
        alone = relax(n, requests(spark, [(0, None)]), Setup(models(), CostModel(w, rates))).collect()
        strip = lambda rows, q: {r.vertex_id: (round(r.g, 9), r.edge_id, round(r.total_cost, 9), r.depth, round(r.state.trip_time, 9)) for r in rows if r.query_id == q}
        assert strip(tree, i) == strip(alone, 0)
    settled = search(n, batch, Setup(models(), CostModel({}, rates, own_weights=True)), "kernel").collect()
    assert {(r.query_id, r.vertex_id): round(r.g, 9) for r in settled} == {(r.query_id, r.vertex_id): round(r.g, 9) for r in tree}


def test_early_ends_are_errors_of_their_requests(spark):
    n = network(spark, [(i, i + 1, 1) for i in range(20)])
    asked = requests(spark, [(0, 2), (0, 20), (5, None)])
    for engine in ("relax", "kernel"):
        tree, errors = answered(n, asked, kilometres(limits=Limits(rounds=6)), engine)
        assert [(r.query_id, r.error.split(":")[0]) for r in errors.collect()] == [(1, "search ended early")]
        got = found(tree, asked)
        assert got[0] == ([0, 1], 2) and 1 not in got
    tree, errors = answered(n, asked, kilometres(limits=Limits(labels=4)))
    assert {r.query_id for r in errors.collect()} == {1} and found(tree, asked)[0] == ([0, 1], 2)
    settled = search(n, requests(spark, [(0, None)]), kilometres(limits=Limits(rounds=10)), "kernel").count()
    assert settled == 11
    assert Limits.of({"type": "memory", "limit": 1}).labels == 8192


def test_the_clock_is_looked_at_after_so_many_labels_only(spark):
    n = network(spark, [(i, i + 1, 1) for i in range(6)])
    asked = requests(spark, [(0, 6)])
    for every, late in ((100_000, False), (3, True)):
        limits = Limits.of({"type": "query_runtime", "limit": "00:00:00", "frequency": every})
        tree, errors = answered(n, asked, kilometres(limits=limits))
        assert errors.isEmpty() != late and (late or found(tree, asked)[0][1] == 6)


def test_a_heuristic_changes_no_answer(spark):
    r = random.Random(3)
    places = [(r.random() / 10, r.random() / 10) for _ in range(14)]
    rows = [(s, d, 40.0 + k) for s, d, k in random_rows(3)]
    n, asked = network(spark, rows, places), requests(spark, [(0, d) for d in range(1, 14)])
    assert found(search(n, asked, kilometres(heuristic=True)), asked) == found(search(n, asked, kilometres()), asked)


def test_long_routes_by_pointer_doubling(spark):
    n = network(spark, [(i, i + 1, 1) for i in range(37)] + [(0, 37, 100)])
    asked = requests(spark, [(0, 37), (3, 30), (5, 5)])
    assert found(search(n, asked, kilometres()), asked) == {0: (list(range(37)), 37), 1: (list(range(3, 30)), 27)}


def test_steps_of_no_length_make_no_circle(spark):
    rows = [(0, 1, 1000.0), (1, 2, 0.0), (2, 1, 0.0), (2, 3, 0.0), (3, 1, 0.0), (0, 3, 1000.0)]
    asked = requests(spark, [(0, None), (0, 2)])
    tree = relax(network(spark, rows), asked, kilometres())
    assert {r.vertex_id for r in tree.collect() if r.query_id == 0} == {0, 1, 2, 3}
    assert found(tree, asked)[1][1] == 1000


def test_labels_keep_apart_what_differs():
    assert [SocBins([10.0, 50.0, 100.0]).bin({"trip_soc": s}) for s in (0.05, 0.1, 0.3, 0.9, 1.2)] == [0, 0, 1, 2, 2]


def simple_paths(rows, origin, destination):
    out = []

    def walk(v, seen, edges, cost):
        if v == destination:
            out.append((cost, edges))
            return
        for i, (s, d, k) in enumerate(rows):
            if s == v and d not in seen:
                walk(d, seen | {d}, [*edges, i], cost + k)

    walk(origin, {origin}, [], 0)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_yens_against_enumeration(spark, seed):
    rows = random_rows(seed, 7, 22)
    asked = [(0, 6), (2, 5)]
    got = ksp.yens(network(spark, rows), requests(spark, asked), kilometres(), k=4).collect()
    for q, (o, d) in enumerate(asked):
        mine = sorted((r.route_idx, r.cost, [e.edge_id for e in r.edges]) for r in got if r.query_id == q)
        want = simple_paths(rows, o, d)[:4]
        assert [m[1] for m in mine] == [float(w[0]) for w in want]
        assert all((m[1], m[2]) in [(float(c), e) for c, e in simple_paths(rows, o, d)] for m in mine)


def test_single_via(spark):
    rows = [(0, 1, 1), (1, 5, 1), (0, 2, 1.5), (2, 5, 1.5), (0, 3, 2), (3, 5, 2)]
    got = ksp.single_via(network(spark, rows), requests(spark, [(0, 5)]), kilometres(), k=2, similarity=ksp.Similarity("edge_id_cosine", 0.5)).orderBy("route_idx").collect()
    assert [[e.edge_id for e in r.edges] for r in got] == [[0, 1], [2, 3]] and [r.cost for r in got] == [2, 3]


def test_single_via_goes_past_a_long_shortest_route(spark):
    # Thirteen vertices of the shortest route tie at the least cost; the other route's come after them.
    rows = [(i, i + 1, 1) for i in range(12)] + [(0, 13, 8), (13, 12, 8)]
    got = ksp.single_via(network(spark, rows), requests(spark, [(0, 12)]), kilometres(), k=2, similarity=ksp.Similarity("edge_id_cosine", 0.8), candidates=4).orderBy("route_idx").collect()
    assert [[e.edge_id for e in r.edges] for r in got] == [list(range(12)), [12, 13]] and [r.cost for r in got] == [12, 16]


def test_yens_goes_on_until_k_routes_are_not_alike(spark):
    # The second and third routes share most edges with the first; the fourth shares none.
    rows = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (3, 4, 1.5), (3, 4, 1.75), (0, 5, 4), (5, 4, 4)]
    got = ksp.yens(network(spark, rows), requests(spark, [(0, 4)]), kilometres(), k=2, similarity=ksp.Similarity("edge_id_cosine", 0.5)).orderBy("route_idx").collect()
    assert [[e.edge_id for e in r.edges] for r in got] == [[0, 1, 2, 3], [6, 7]] and [r.cost for r in got] == [4, 8]


@pytest.mark.parametrize("seed", [1, 2])
def test_single_via_against_enumeration(spark, seed):
    rows = random_rows(seed, 8, 26)
    asked = [(0, 7), (2, 5)]
    alike = ksp.Similarity("edge_id_cosine", 0.6)
    got = ksp.single_via(network(spark, rows), requests(spark, asked), kilometres(), k=3, similarity=alike, candidates=2).collect()
    for q, (o, d) in enumerate(asked):
        # Routes by way of each vertex: the cheapest way there (ties by edge ids) and on, without a loop.
        ahead, back = dijkstra(rows, o), dijkstra([(b, a, k) for a, b, k in rows], d)
        whole = {v: ahead[v] + back[v] for v in ahead if v in back}
        mine = sorted((r.route_idx, r.cost, [e.edge_id for e in r.edges]) for r in got if r.query_id == q)
        assert not whole or mine[0][1] == min(whole.values())
        for _, c, edges in mine:
            steps = [rows[i] for i in edges]
            assert c == sum(k for _, _, k in steps) and c in whole.values() and steps[0][0] == o and steps[-1][1] == d
            assert all(a[1] == b[0] for a, b in itertools.pairwise(steps)) and len({s for s, _, _ in steps}) == len(steps)
        for i, a in enumerate(mine):
            for b in mine[:i]:
                assert len(set(a[2]) & set(b[2])) / (len(a[2]) * len(b[2])) ** 0.5 < 0.6


def test_similarity_and_equality(spark):
    route = lambda ids: spark.createDataFrame([(0, 0, i, float(i + 1)) for i in ids], "query_id long, edge_list_id int, edge_id long, distance_m double")
    got = lambda a, b, w=False: ksp.cosine(route(a), route(b), ["query_id"], w).first().similarity
    assert got([0, 1], [0, 1]) == pytest.approx(1) and got([0, 1], [2, 3]) == 0 and got([0, 1], [1, 2]) == pytest.approx(0.5)
    assert got([0, 1], [1, 2], True) == pytest.approx(4 / (5**0.5 * 13**0.5))
    r = spark.range(1).select(ksp.same_route(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2))), ksp.same_route(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))).first()
    assert tuple(r) == (True, False)
    assert ksp.KspLimit("factor", 3).rounds(4) == 12 and ksp.KspLimit("max_iteration", 3).rounds(4) == 3


def test_loops(spark):
    rows = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (1, 0, 1), (1, 0, 1)], "query_id long, route_idx int, from_vertex long")
    assert {r.query_id: r.loop for r in has_loop(rows).collect()} == {0: False, 1: True}


def test_edge_oriented(spark):
    n = network(spark, SQUARE)
    asked = spark.createDataFrame([(0, 0, 7, 0, 3), (1, 0, 2, 0, 2)], "query_id long, origin_list int, origin_edge long, destination_list int, destination_edge long")
    ends = ksp.edge_oriented(n, asked)
    got = {r.query_id: (r.origin, r.destination) for r in ends.collect()}
    assert got == {0: (3, 2), 1: (2, 2)}
    way = routes(relax(n, ends, kilometres()), ends)
    around = [(r.edge_list_id, r.edge_id) for r in ksp.with_end_edges(way, ends).filter("query_id = 0").orderBy("pos").collect()]
    assert around == [(0, 7), (0, 5), (0, 3)]


def test_components(spark):
    rows = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1), (0, 2, 1), (2, 0, 1), (4, 4, 1), (0, 4, 1)]
    parts = strong_components(network(spark, rows))
    assert {r.vertex_id: r.component for r in parts.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert sorted(r.vertex_id for r in largest_component(parts).collect()) == [0, 1, 2, 3]
    for seed in range(2):
        rows = random_rows(seed, 16, 26)
        reach = {v: set(dijkstra(rows, v)) for v in range(16)}
        want = {v: min(w for w in reach[v] if v in reach[w]) for v in range(max(max(r[:2]) for r in rows) + 1)}
        assert {r.vertex_id: r.component for r in strong_components(network(spark, rows)).collect()} == want


def test_bad_references(spark):
    n = network(spark, SQUARE)
    broken = Network(n.vertices.filter("vertex_id <> 3"), n.edges)
    assert broken.bad_references().count() == 4
    with pytest.raises(NetworkError):
        broken.validated()
    with pytest.raises(NetworkError):
        n.require_edge(0, 99)
    assert n.dense(n.edges, "edge_id") and not broken.dense(broken.vertices.withColumn("vertex_id", F.col("vertex_id") * 2), "vertex_id")


def test_bucketed_edges_are_not_exchanged(spark):
    n = network(spark, SQUARE).cached(buckets=4)
    asked = requests(spark, [(0, 1)])
    assert found(relax(n, asked, kilometres()), asked)[0] == ([7, 5, 3], 5)


def test_batches_do_not_depend_on_order(spark):
    pairs = list(itertools.permutations(range(4), 2))
    a, b = requests(spark, pairs), requests(spark, pairs).orderBy(F.desc("query_id"))
    n = network(spark, SQUARE)
    assert found(relax(n, a, kilometres()), a) == found(relax(n, b, kilometres()), b)


def test_custom_accumulators(spark):
    n = network(spark, SQUARE)
    setup = Setup([Custom("metres", "distance_m", accumulator=True)], CostModel({"metres": 1.0}, {"metres": Rate()}))
    asked = requests(spark, [(0, 1)])
    assert found(search(n, asked, setup), asked)[0] == ([7, 5, 3], 5000)


def test_costs_alone_are_those_of_the_tree(spark, monkeypatch):
    from wayfold.plans import search as plans

    n, asked = network(spark, SQUARE), requests(spark, [(0, None), (2, None)])
    for setup in (kilometres(), kilometres(direction="reverse")):
        want = {(r.query_id, r.vertex_id): r.g for r in relax(n, asked, setup).collect()}
        with monkeypatch.context() as m:
            m.setattr(plans, "_explained", None)
            assert {(r.query_id, r.vertex_id): r.g for r in plans.least_costs(n, asked, setup).collect()} == want


def test_a_network_that_is_written_is_not_written_again(spark):
    once = Network(network(spark, SQUARE).vertices, network(spark, SQUARE).edges).cached()
    assert once.cached() is once


def test_edges_are_read_whole_only_while_new_vertices_are_reached(spark, monkeypatch):
    """A ring of four and a far part: rounds in which costs get better, but no vertex is new, read the reached part alone."""
    from wayfold.plans import search as module

    made = []
    real = module.Nearby
    monkeypatch.setattr(module, "Nearby", lambda *a: made.append(real(*a)) or made[-1])
    rows = [(0, 1, 9), (0, 2, 1), (2, 1, 1), (1, 3, 5), (3, 0, 1), (4, 5, 1), (5, 4, 1), (2, 4, 0.5), (4, 3, 0.5), (6, 7, 1)]
    g = {r["vertex_id"]: round(r["g"], 6) for r in relax(network(spark, rows), requests(spark, [(0, None)]), kilometres()).collect()}
    assert g == {0: 0, 1: 2, 2: 1, 3: 2, 4: 1.5, 5: 2.5}
    held = made[0].edges(spark.createDataFrame([(0,)], "vertex_id long"))
    assert sorted((r["src"], r["dst"]) for r in held.collect()) == sorted((s, d) for s, d, _ in rows if s < 6)
    assert made[0].reads == 4 and sum(n for n, _, _ in made[0].parts) == 6


def test_kernels_of_large_networks_get_what_they_read_and_can_reach(spark, monkeypatch):
    from wayfold.plans import search as module

    rows = [(0, 1, 1), (1, 2, 2), (2, 0, 3), *((i, i + 1, 1) for i in range(3, 9))]
    n, asked = network(spark, rows), requests(spark, [(0, None), (1, None)])
    tree = lambda: sorted((r["query_id"], r["vertex_id"], round(r["g"], 6)) for r in search(n, asked, kilometres(), "kernel").collect())
    whole = tree()
    monkeypatch.setattr(module, "KERNEL_BYTES", 3 * 8 * 6)  # three edges of six columns; the network has nine of nine
    assert tree() == whole and len(whole) == 6
    with pytest.raises(SearchError, match="too many"):
        search(n, requests(spark, [(3, None)]), kilometres(), "kernel")
