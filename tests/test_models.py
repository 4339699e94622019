import pytest
from pyspark.sql import functions as F

from wayfold.functions import units
from wayfold.operators import cost, energy
from wayfold.operators.models import Columns, Custom, Distance, Elevation, Feature, Grade, ModelError, Numbers, Speed, Temperature, Time, TraversalModel, TurnDelay, fastest_mph, features_of, ordered, step

EDGE = {"distance_m": 1609.344, "speed_kph": 96.56064, "grade": -0.05, "custom": 2.0, "flag": True, "src_x": 0.0, "src_y": 0.0, "dst_x": 0.0, "dst_y": 0.01, "arrival_heading": 90, "prev_departure_heading": None}


def run(chain, before=None, edge=EDGE, q=None, estimate=False):
    chain = ordered(chain)
    features = features_of(chain)
    return step(Numbers, chain, features, edge, {f.name: f.initial for f in features} | (before or {}), q or {}, estimate)


def test_distance_speed_time_grade_and_elevation():
    s = run([Elevation(), Grade(), Time(), Speed(), Distance()], {"trip_time": 5.0, "trip_elevation_loss": -1.0})
    assert s["edge_distance"] == pytest.approx(1) and s["edge_speed"] == pytest.approx(60) and s["edge_time"] == pytest.approx(1) and s["trip_time"] == pytest.approx(6)
    assert s["edge_grade"] == -0.05 and s["trip_elevation_loss"] == pytest.approx(-1.05) and s["trip_elevation_gain"] == 0
    assert "trip_distance" not in {f.name for f in features_of([Distance(False)])}


def test_speed_limits_and_tables(spark):
    assert run([Speed()], q={"speed_limit": 5.0, "speed_limit_unit": "kph"})["edge_speed"] == pytest.approx(3.1068559)
    assert run([Speed()], q={"speed_limit": 500.0, "speed_limit_unit": "kph"})["edge_speed"] == pytest.approx(60)
    with pytest.raises(ModelError):
        run([Speed()], q={"speed_limit": 5.0})
    assert fastest_mph(spark.createDataFrame([(10.0,), (40.0,)], "speed_kph double")) == pytest.approx(24.854848)
    for rows in ([], [(0.0,)]):
        with pytest.raises(ModelError):
            fastest_mph(spark.createDataFrame(rows, "speed_kph double"))


def test_a_way_without_speed_takes_for_ever():
    assert run([Distance(), Speed(), Time()], edge=EDGE | {"speed_kph": 0.0})["edge_time"] == float("inf")
    assert run([Distance(), Speed(), Time()], edge=EDGE | {"speed_kph": 0.0, "distance_m": 0.0})["edge_time"] == 0


def test_temperature_custom_and_turns():
    assert run([Temperature(70.0)])["ambient_temperature"] == pytest.approx(294.261, abs=1e-3)
    assert run([Temperature()], q={"ambient_temperature": 0.0, "ambient_temperature_unit": "c"})["ambient_temperature"] == 273.15
    with pytest.raises(ModelError):
        run([Temperature()])
    assert run([Custom("c", "custom")])["c"] == 2 and run([Custom("c", "custom", accumulator=True)], {"c": 3.0})["c"] == 5
    assert run([Custom("c", "flag", boolean=True, accumulator=True, initial=1.0)], {"c": 0.0})["c"] == 0
    with pytest.raises(ModelError):
        TurnDelay({"left": 1.0})


def test_order_of_models():
    names = lambda chain: [type(m).__name__ for m in ordered(chain)]
    assert names([Time(), Speed(), Distance()]).index("Time") == 2
    with pytest.raises(ModelError):
        ordered([Time(), Speed()])

    class A(TraversalModel):
        inputs, outputs = ["b"], [Feature("a", "custom")]

    class B(TraversalModel):
        inputs, outputs = ["a"], [Feature("b", "custom")]

    class Own(TraversalModel):
        inputs, outputs = ["own"], [Feature("own", "custom")]

    with pytest.raises(ModelError):
        ordered([A(), B()])
    assert len(ordered([Own()])) == 1
    with pytest.raises(ModelError):
        features_of([Distance()], {"nothing": 1.0})
    assert {f.name: f.initial for f in features_of([Distance()], {"trip_distance": 4})}["trip_distance"] == 4.0


def test_both_arithmetics_agree(spark):
    p = energy.Prediction.of_function(lambda v, g: 0.02 + 0.0001 * v + 0.002 * g * g, [("edge_speed", "speed", "mph"), ("edge_grade", "ratio", "percent")], [(0.0, 100.0, 21), (-20.0, 20.0, 9)], "kilowatt_hours_per_mile")
    chain = ordered([Distance(), Speed(), Time(), Grade(), Elevation(), energy.PhevEnergy(p, energy.Prediction(p.inputs, p.axes, p.values, "gallons_gasoline_per_mile"), 0.03)])
    features = features_of(chain)
    rows = [(100.0 * k, 10.0 * k, 0.01 * (k - 4), 0.1 * k) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "distance_m double, speed_kph double, grade double, soc double")
    start = {f.name: F.lit(f.initial) for f in features} | {"trip_soc": F.col("soc")}
    s = step(Columns, chain, features, {c: F.col(c) for c in df.columns}, start, {})
    for row in df.select("*", F.struct(*[s[f.name].cast("double").alias(f.name) for f in features]).alias("s")).collect():
        want = step(Numbers, chain, features, row.asDict(), {f.name: f.initial for f in features} | {"trip_soc": row.soc}, {})
        for f in features:
            assert row.s[f.name] == pytest.approx(want[f.name], rel=1e-9, abs=1e-12), f.name


def grid(rate=0.5, unit="kilowatt_hours_per_mile"):
    return energy.Prediction([("edge_speed", "speed", "mph")], [(0.0, 100.0, 2)], [rate, rate], unit)


def test_battery_vehicles():
    edge = EDGE | {"distance_m": 1609.344 * 110}
    s = run([Distance(), Speed(), energy.BevEnergy(grid(0.27), 60.0)], edge=edge)
    assert 0.4 < s["trip_soc"] < 0.6 and s["trip_energy_electric"] / energy.KWH == pytest.approx(29.7)
    assert run([Distance(), Speed(), energy.BevEnergy(grid(9.0), 60.0)], edge=edge)["trip_soc"] == 0
    assert run([Distance(), Speed(), energy.BevEnergy(grid(-9.0), 60.0)], {"trip_soc": 0.9}, edge=edge)["trip_soc"] == 1
    assert energy.start_soc({"starting_soc_percent": 40}) == 0.4
    with pytest.raises(ModelError):
        energy.start_soc({"starting_soc_percent": 140})


def test_hybrids_empty_the_battery_first():
    edge = EDGE | {"distance_m": 1609.344 * 100}
    s = run([Distance(), Speed(), energy.PhevEnergy(grid(0.3), grid(0.02, "gallons_gasoline_per_mile"), 12.0)], edge=edge)
    assert s["trip_energy_electric"] / energy.KWH == pytest.approx(12) and s["trip_soc"] == pytest.approx(0, abs=1e-12)
    assert s["trip_energy_liquid"] == pytest.approx(2 * (1 - 12 / 30))
    assert run([Distance(), Speed(), energy.PhevEnergy(grid(0.1), grid(0.02, "gallons_gasoline_per_mile"), 12.0)], edge=edge)["trip_energy_liquid"] == 0


def test_engines(spark):
    s = run([Distance(), Speed(), energy.IceEnergy(grid(0.04, "gallons_gasoline_per_mile"))])
    assert s["trip_energy_liquid"] == pytest.approx(0.04)
    with pytest.raises(ModelError):
        energy.IceEnergy(grid())
    p = energy.Prediction([("edge_speed", "speed", "mph"), ("edge_grade", "ratio", "percent")], [(0.0, 100.0, 3), (-20.0, 20.0, 3)], [0.3, 0.2, 0.9] * 3, "gallons_gasoline_per_mile")
    assert energy.best_rate(spark, p) == pytest.approx(0.2)


def charge(soc, kw=50.0, kind="DCFC", types=None):
    state = {"trip_soc": soc, "battery_capacity": 60 * energy.KWH, "edge_time": 0.0, "trip_time": 1.0}
    return energy.SimpleCharging(power_types=types).traverse(Numbers, {"station_kw": kw, "station_type": kind}, state, {})


def test_charging():
    s = charge(0.15)
    assert s["trip_soc"] == 1 and s["edge_time"] == pytest.approx(51 / 50 * 60) and s["trip_time"] == pytest.approx(1 + 61.2)
    for same in (charge(0.5), charge(0.15, None, None), charge(0.15, types=["L2"])):
        assert same["edge_charging_time"] == 0 and same["trip_time"] == 1.0
    assert charge(0.1, 7.2, "L2")["edge_time"] > charge(0.1)["edge_time"]


def test_vehicle_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "A", "type": "ice", "energy_rate_unit": "gallons_gasoline_per_mile", "real_world_energy_adjustment": 1.2, "input_features": [{"name": "edge_speed", "type": "speed", "unit": "mph"}], "model_type": {"interpolate": {"feature_bounds": {"edge_speed": {"lower_bound": 0, "upper_bound": 100, "num_bins": 2}}}}}')
    library = energy.VehicleLibrary.read(spark, str(tmp_path / "*.json"), {"A": [0.1, 0.2]})
    m = library.model({"model_name": "A"})
    assert isinstance(m, energy.IceEnergy) and run([Distance(), Speed(), m])["trip_energy_liquid"] == pytest.approx(0.16 * 1.2)
    for q in ({}, {"model_name": "B"}):
        with pytest.raises(ModelError):
            library.model(q)


TRIP, EDGE_D = Feature("trip_distance", "distance", True), Feature("edge_distance", "distance")


def test_costs():
    miles = lambda m: m / 1609.344
    model = cost.CostModel({"trip_distance": 1.0}, {"trip_distance": cost.Rate("distance", 1.0, "meters")}).checked([TRIP])
    assert model.costs(Numbers, [TRIP], {"trip_distance": miles(100)}, {"trip_distance": miles(150)})[1] == pytest.approx(50)
    free = cost.CostModel({"trip_distance": 1.0}, {"trip_distance": cost.Rate("zero")}, {"trip_distance": ["fee"]}).checked([TRIP])
    assert abs(free.costs(Numbers, [TRIP], {"trip_distance": 0.0}, {"trip_distance": 1.0}, {"fee": 5.0})[1]) < 1e-6
    paid = cost.CostModel({"edge_distance": 2.0}, {"edge_distance": cost.Rate("raw")}, {"edge_distance": ["fee"]}).checked([EDGE_D])
    assert paid.costs(Numbers, [EDGE_D], {"edge_distance": 0.0}, {"edge_distance": 1.0}, {"fee": 5.0}) == (12, 6)
    gains = model.costs(Numbers, [TRIP], {"trip_distance": 2.0}, {"trip_distance": 1.0})
    assert gains == (cost.LEAST, cost.LEAST)
    assert model.merged({"trip_distance": 4.0}, {"trip_distance": "raw"}).weights == {"trip_distance": 4.0}
    assert model.description()[0]["feature"] == "trip_distance"


def test_costs_that_are_none():
    for weights, rates in (({"nothing": 1.0}, {}), ({"trip_distance": 0.0}, {"trip_distance": cost.Rate()}), ({"trip_distance": -1.0}, {"trip_distance": cost.Rate()}), ({"trip_distance": 1.0}, {})):
        with pytest.raises(cost.CostError):
            cost.CostModel(weights, rates).checked([TRIP])
    kept = cost.CostModel({"nothing": 1.0, "trip_distance": 1.0}, {"trip_distance": cost.Rate()}, ignore_unknown=True).checked([TRIP])
    assert kept.weights == {"trip_distance": 1.0}
    with pytest.raises(cost.CostError):
        cost.Rate.of({"type": "odd"})
    with pytest.raises(cost.CostError):
        cost.Rate("time").value(1.0, TRIP)


def test_aggregation(spark):
    rows = spark.createDataFrame([([],), ([1.0],), ([0.5, 0.5],)], "c array<double>")
    assert [r[0] for r in rows.select(cost.aggregate(F.col("c"))).collect()] == [0, 1, 1]
    assert [r[0] for r in rows.select(cost.aggregate(F.col("c"), "mul")).collect()] == [0, 1, 0.25]


def test_energy_rates_have_units():
    assert set(units.RATES) == {"gallons_gasoline_per_mile", "gallons_diesel_per_mile", "kilowatt_hours_per_mile", "kilowatt_hours_per_kilometer"}
