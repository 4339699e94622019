import math
import struct

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, interpolate, text, units
from wayfold.operators.constraints import compare
from wayfold.operators.models import Numbers, bearing_change, turn_class
from wayfold.plans.scratch import written


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_units(spark):
    assert units.convert(1.0, "distance", "mi", "ft") == pytest.approx(5280)
    assert units.convert(100.0, "speed", "kph", "mph") == pytest.approx(62.137119)
    assert units.convert(1.0, "energy", "gge", "kwh") == pytest.approx(35.231384)
    assert units.convert(25.0, "ratio", "percent", "decimal") == 0.25
    assert units.convert(212.0, "temperature", "f", "c") == pytest.approx(100)
    assert units.convert(0.0, "temperature", "kelvin", "celsius") == -273.15
    assert units.convert(1.0, "weight", "tons", "lbs") == pytest.approx(2204.6226)
    assert units.unit_of("distance", " Miles ") == "miles" and units.unit_of("volume", "gal") == "gallons_us"
    for kind, name in (("distance", "furlong"), ("time", "Hours"), ("temperature", "x")):
        with pytest.raises(ValueError):
            units.unit_of(kind, name)
    rows = spark.createDataFrame([(1.0, "KM"), (2.0, "ft"), (1.0, "x")], "v double, u string")
    got = [r[0] for r in rows.select(units.convert_named(F.col("v"), "distance", F.col("u"), "m")).collect()]
    assert got[0] == 1000 and got[1] == pytest.approx(0.6096) and got[2] is None


@pytest.mark.parametrize(("departure", "arrival", "want"), [(90, 90, 0), (10, 350, -20), (350, 10, 20), (0, 180, 180), (180, 0, -180)])
def test_bearing_change(departure, arrival, want):
    assert bearing_change(Numbers, departure, arrival) == want


def test_turn_bands():
    angles = [-160, -159, -135, -134, -45, -44, -20, -19, 19, 20, 44, 45, 134, 135, 159, 160]
    names = "u_turn sharp_left sharp_left left left slight_left slight_left no_turn no_turn slight_right slight_right right right sharp_right sharp_right u_turn".split()
    assert [turn_class(Numbers, a) for a in angles] == names


def test_durations(spark):
    r = one(spark, *[text.duration(F.lit(ms)).alias(f"c{i}") for i, ms in enumerate((28_800_000, 29_343_000, 108_208_019, 0))])
    assert tuple(r)[:2] == ("8:00:00.000", "8:09:03.000") and r[3] == "0:00:00.000"
    assert r[2] == "+1.6:03:28.019"


def test_prices(spark):
    cases = {"$0.20 per kWh": 0.2, "$0.15/kWh": 0.15, "$0.30 kWh": 0.3, "$2.00 session fee + $0.25/kWh": 0.25, "$5.00 flat rate": 0, "Free": 0, None: 0, "": 0}
    rows = spark.createDataFrame([(k, float(v)) for k, v in cases.items()], "t string, v double")
    assert rows.filter(text.price_per_kwh(F.col("t")) != F.col("v")).count() == 0


def test_lines(spark):
    wkt = "LINESTRING (0 0, 1.5 2, -3 4)"
    line = geo.points_of_wkt(F.lit(wkt))
    r = one(spark, line.alias("a"), geo.line_wkt(line).alias("b"), geo.points_of_wkt(F.lit("POINT (1 2)")).alias("c"), geo.concat_lines(F.array(line, line, line)).alias("d"))
    assert [(p.x, p.y) for p in r.a] == [(0, 0), (1.5, 2), (-3, 4)] and r.c is None and len(r.d) == 9
    assert r.b == "LINESTRING (0.0 0.0, 1.5 2.0, -3.0 4.0)"
    back = spark.range(1).select(line.alias("l")).select(geo.line_wkb("l").alias("w")).select("w", geo.points_of_wkb("w").alias("p")).first()
    assert struct.unpack_from("<BII", bytes(back.w)) == (1, 2, 3) and [(p.x, p.y) for p in back.p] == [(0, 0), (1.5, 2), (-3, 4)]


def test_distances_and_bearings(spark):
    r = one(spark, geo.haversine_m(*map(F.lit, (0.0, 0.0, 0.0, 1.0))).alias("a"), geo.haversine_m(*map(F.lit, (0.0, 0.0, 181.0, 1.0))).alias("b"), geo.bearing(*map(F.lit, (0.0, 0.0, 1.0, 0.0))).alias("c"), geo.bearing(*map(F.lit, (0.0, 0.0, -1.0, 0.0))).alias("d"))
    assert r.a == pytest.approx(math.pi * 6_371_000 / 180) and r.b is None and (r.c, r.d) == (90, 270)


def test_polygons(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    inside = lambda x, y: geo.in_ring(F.lit(x), F.lit(y), ring)
    r = one(spark, inside(0.5, 1.0), inside(2.0, 3.0), inside(3.9, 3.0), inside(5.0, 1.0))
    assert tuple(r) == (True, False, True, False)
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 0), (3, 0), (3, 2), (1, 2))])
    whole = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    assert spark.range(1).select(geo.overlap_area(whole, square)).first()[0] == pytest.approx(2)


def test_interpolation_is_exact_for_linear_functions_and_clamped(spark):
    axes = [(0.0, 10.0, 6), (-1.0, 1.0, 5), (0.0, 1.0, 3)]
    f = lambda a, b, c: 2 * a - 3 * b + c + 1
    values = [f(a, b, c) for a in interpolate.linspace(*axes[0]) for b in interpolate.linspace(*axes[1]) for c in interpolate.linspace(*axes[2])]
    for at in ((3.3, 0.21, 0.7), (0.0, -1.0, 0.0), (10.0, 1.0, 1.0), (99.0, 5.0, -4.0)):
        want = f(min(max(at[0], 0), 10), min(max(at[1], -1), 1), min(max(at[2], 0), 1))
        assert one(spark, interpolate.interpolate(values, axes, [F.lit(x) for x in at]))[0] == pytest.approx(want)
        assert interpolate.interpolate_point(values, axes, list(at)) == pytest.approx(want)
    assert one(spark, interpolate.interpolate([1.0, 3.0], [(0.0, 1.0, 2)], [F.lit(0.25)]))[0] == 1.5


def test_comparisons(spark):
    r = one(spark, *[compare(F.lit(2.0), F.lit(op), F.lit(3.0)).alias(f"c{i}") for i, op in enumerate(("<", ">", "=", "<=", ">=", "!"))])
    assert tuple(r) == (True, False, False, True, False, None)


def test_points_on_a_ring_are_outside(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    at = [(2.0, 0.0), (0.0, 2.0), (4.0, 2.0), (0.0, 0.0), (2.0, 1.0), (3.0, 2.5), (2.0, 0.5)]
    assert tuple(one(spark, *[geo.in_ring(F.lit(x), F.lit(y), ring) for x, y in at])) == (*[False] * 6, True)


def test_large_tables_are_dealt_over_more_tasks(spark):
    from wayfold.plans.scratch import spread

    rows = spark.range(1000).selectExpr("id % 50 AS k", "id AS v")
    many = spread(rows, "k", rows=100)
    assert many.rdd.getNumPartitions() == 10 and many.count() == 1000
    assert spread(rows, rows=50).rdd.getNumPartitions() == 20


def test_turns_are_counted_without_listing_pairs(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["turn_restriction"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "prev_edge_id" not in plan


def test_lines_of_edges_read_a_network_that_is_written_once(spark, monkeypatch):
    """Sorting, writing and counting the lines must not derive the network from its tables again."""
    from wayfold import operator_queries as module

    made = []
    real = module.derived_network
    monkeypatch.setattr(module, "derived_network", lambda *a: made.append(real(*a)) or made[-1])
    rows = module.geometry_lines(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and written(made[0].edges)
    assert rows.count() == made[0].edges.count()
