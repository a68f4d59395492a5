import random

import pytest
from pyspark.sql import functions as F

from treelake import ranges
from treelake.operators import arrays


def test_numbered_against_a_plain_sort(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.randrange(5000), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ranges.numbered(df, ["k"], ["v", "i"], "at").collect()
        plain = ranges.numbered(df, [], [F.col("v").desc(), "i"], "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for k in {r[0] for r in rows}:
        for at, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])):
            want[r[2]] = at
    assert {r.i: r.at for r in got} == want
    assert [r.i for r in sorted(plain, key=lambda r: r.at)] == [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]


def test_numbered_of_ties_and_nothing(spark):
    same = spark.range(500).select(F.lit(1).alias("k"), F.lit(None).cast("long").alias("v"))
    assert sorted(r.at for r in ranges.numbered(same, ["k"], ["v"], "at").collect()) == list(range(500))
    assert ranges.numbered(same.limit(0), ["k"], ["v"], "at").count() == 0


@pytest.fixture
def narrow(spark):
    """Many small ranges, none of them joined again."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _series(spark):
    rng = random.Random(8)
    rows, at = [], {}
    for n in range(1500):
        k = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", "c", None])
        at[k] = at.get(k, 0) + rng.choice([1, 1, 2, 9])
        rows.append((k, at[k], float(n % 17) if n % 29 else None))
    return rows, spark.createDataFrame(rows, "k string, x long, v double").repartition(5, "v")


@pytest.mark.parametrize("size", [1, 10, 200])
def test_rolling_mean_over_ranges(spark, narrow, size):
    rows, df = _series(spark)
    got = {(r.k, r.x): r.rolling for r in arrays.rolling_mean(df, ["k"], "x", size).collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == k)
        for n, (x, _) in enumerate(own):
            last = [v for _, v in own[max(0, n - size + 1) : n + 1] if v is not None]
            assert got[k, x] == (pytest.approx(sum(last) / size) if len(last) == size else None)


def test_nearest_join_over_ranges(spark, narrow):
    rows, df = _series(spark)
    rng = random.Random(9)
    # Whole stretches of requests hold no coordinate, and of coordinates no request.
    coords = [(k, n, float(x)) for n, (k, x, _) in enumerate(rows) if not 900 < x < 2500] + [("hot", 9999, 5.0), ("hot", 3, None)]
    asked = [(k, rng.choice([rng.uniform(-50, 5000), rng.uniform(1000, 2400)])) for k in ["hot"] * 700 + ["a", "b"] * 40 + ["none"] * 5] + [("hot", None), ("a", 1.5), ("a", 1.5)]
    got = arrays.nearest_join(spark.createDataFrame(asked, "k string, request double"), spark.createDataFrame(coords, "k string, i long, coord double"), ["k"]).collect()
    assert len(got) == len(asked)
    for r in got:
        own = [(abs(c - r.request), i, c) for k, i, c in coords if k == r.k and c is not None] if r.request is not None else []
        assert (r.i, r.coord) == (min(own)[1:] if own else (None, None))


def test_coordinates_are_ranked_by_ranges(spark, narrow):
    grid = spark.range(300).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y"), F.lit(1.0).alias("v"))
    known = [("x", i, float(i)) for i in range(300)] + [("y", i, float(i)) for i in range(7)]
    schema = "name string, index long, v double"
    assert arrays.to_datasets(grid, ["x", "y"], ["v"], spark.createDataFrame(known, schema)).count() == 300
    with pytest.raises(Exception, match="with other values: y"):
        arrays.to_datasets(grid, ["x", "y"], ["v"], spark.createDataFrame([*known[:-1], ("y", 6, 6.5)], schema)).count()
