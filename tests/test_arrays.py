import math
import random

import pytest
from pyspark.sql import functions as F

from treelake.functions import units
from treelake.operators import arrays


@pytest.fixture(scope="module")
def vel(spark):
    return spark.createDataFrame([("d", i, float(i + 1), 1.5 + i) for i in range(3)], "file_id string, i int, coord double, v double").cache()


def test_selection(spark, vel):
    assert arrays.isel(vel, i=2).first().v == 3.5
    assert arrays.isel(vel, {"i": 3}, i=-1).first().v == 3.5
    assert sorted(r.i for r in arrays.isel(vel, {"i": 3}, i=slice(None, -1)).collect()) == [0, 1]
    assert arrays.isel(vel, i=[1, 1, 0]).count() == 2
    with pytest.raises(ValueError):
        arrays.isel(vel, i=-1)
    hit, missing = arrays.sel_exact(vel, spark.createDataFrame([(2.0,), (1.2,)], "coord double"))
    assert hit.first().v == 2.5 and missing.first().coord == 1.2
    near = arrays.sel_nearest(vel.select("file_id", "i", "coord"), [1.2, 1.5, 99.0], ["file_id"])
    assert {r.request: r.i for r in near.collect()} == {1.2: 0, 1.5: 0, 99.0: 2}


def test_many_nearest_requests(spark):
    x = [10 * k / 6 for k in range(7)]
    coords = spark.createDataFrame([("d", i, c) for i, c in enumerate(x)], "k string, i long, coord double")
    near = arrays.sel_nearest(coords, [4.3, 10.9], ["k"])
    assert sorted(r.coord for r in near.collect()) == [pytest.approx(5.0), 10.0]
    rng = random.Random(1)
    asked = [rng.uniform(-3, 14) for _ in range(200)] + x + [(a + b) / 2 for a, b in zip(x, x[1:])]
    got = arrays.nearest_join(spark.createDataFrame([("d", r) for r in asked], "k string, request double"), coords, ["k"]).collect()
    assert len(got) == len(asked)
    for r in got:
        assert r.i == min(range(7), key=lambda i: (abs(x[i] - r.request), i))


def test_decode_and_units(spark):
    v = spark.createDataFrame([("a", 2.3), ("b", 1.0)], "k string, v double")
    one = lambda rows: spark.createDataFrame(rows, "k string, factor double")
    assert {r.k: round(r.decoded, 9) for r in arrays.decode(v, None, one([("a", 0.5)]), ["k"]).collect()} == {"a": 2.8, "b": 1.0}
    km = units.parse_unit("km/s")[0] / units.parse_unit("m/s")[0]
    assert {r.k: r.decoded for r in arrays.decode(v, one([("b", 1.0)]), one([("b", 0.5 * km)]), ["k"]).collect()}["b"] == 501.0
    assert arrays.decode(v, one([("b", 1.0)]), one([("b", km)]), ["k"]).where("k = 'b'").first().decoded == 1001.0


@pytest.mark.parametrize(("text", "factor", "dims"), [
    ("m/s", 1.0, (1, 0, -1)), ("mm", 1e-3, (1, 0, 0)), ("km/h", 1000 / 3600, (1, 0, -1)), ("kg*m/s**2", 1.0, (1, 1, -2)), ("m^-1", 1.0, (-1, 0, 0)), ("1/m", 1.0, (-1, 0, 0)),
    ("", 1.0, (0, 0, 0)), ("m s", 1.0, (1, 0, 1)), ("N/m**2", 1.0, (-1, 1, -2)), ("m/(s*s)", 1.0, (1, 0, -2)), ("1/min", 1 / 60, (0, 0, -1)), ("mmHg", None, None), ("invalid", None, None)])
def test_unit_strings(text, factor, dims):
    got = units.parse_unit(text)
    assert got is None if factor is None else (got[0] == pytest.approx(factor) and got[2][:3] == dims)


def test_conversions(spark):
    df = spark.createDataFrame([("m/s", 1.5), ("s", 3600.0), ("degC", 20.0), ("kg", 1.0), (None, 1.0)], "u string, v double")
    got = {r.u: r for r in df.select("u", units.parse(F.col("u")).alias("p"), "v").select(
        "u", units.convert_to(F.col("v"), F.col("p"), "mm/s").alias("mm"), units.convert_to(F.col("v"), F.col("p"), "h").alias("h"),
        units.convert_to(F.col("v"), F.col("p"), "K").alias("k")).collect()}
    assert got["m/s"].mm == pytest.approx(1500) and got["s"].h == pytest.approx(1) and got["degC"].k == pytest.approx(293.15)
    assert got["kg"].mm is None and got[None].h is None


def test_alignment(spark, vel):
    rows = [("u", 0, 3.0), ("v", 0, 4.0), ("u", 1, 1.0)]
    t = arrays.align(spark.createDataFrame(rows, "name string, x int, v double"), ["x"], ["u", "v"])
    out = {r.x: r for r in arrays.magnitude(t, ["u", "v"]).collect()}
    assert out[0].magnitude_of_u_and_v == 5.0 and out[1].magnitude_of_u_and_v is None
    with pytest.raises(ValueError):
        arrays.magnitude(t, ["u"])
    assert [r.rolling for r in arrays.rolling_mean(vel, ["file_id"], "coord", 2).orderBy("coord").collect()] == [None, 2.0, 3.0]
    assert arrays.dataset_stats(vel, ["file_id"]).first().std == pytest.approx(math.sqrt(2 / 3))
    assert arrays.normalize(vel, 2.0, coord="coord").where("i = 1").first().v_norm == 1.25
    assert arrays.normalized_name("u", "ref") == "u/ref"
    hits = arrays.where_index(spark.range(100).select(F.col("id").alias("i")), F.col("i") > 66, ["i"])
    assert hits.count() == 33


def test_stack_and_attachment(spark, vel):
    images = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [5, 6, 7, 8])], "f int, img array<int>")
    cells = {(r.i0, r.i1, r.i2): r.v for r in arrays.stack(images, "f", "img", -1, [2, 2]).collect()}
    assert cells[(0, 1, 0)] == 2 and cells[(1, 0, 1)] == 7
    assert arrays.stack(images, "f", "img", 0).where("i0 = 1 and i1 = 3").first().v == 8
    scale = spark.createDataFrame([("d", 0, "left")], "file_id string, i int, coord string")
    got = arrays.attach_coords(vel.withColumnRenamed("i", "i0"), scale, "i0", "side").orderBy("i0").collect()
    assert [r.side for r in got] == ["left", None, None]
