import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treelake.model import SCHEMAS, Catalogue
from treelake.operators import filters


def objects(spark, rows):
    full = [(f, n, p, n.rsplit("/", 1)[-1], 0 if n == "/" else n.count("/"), kind, dtype, nd, shape, shape, None, None, None, None, None)
            for f, n, p, kind, dtype, nd, shape in rows]
    return spark.createDataFrame(full, SCHEMAS["objects"])


def attributes(spark, rows):
    full = []
    for f, n, a, v in rows:
        s = v if isinstance(v, str) and not v.startswith("{") else None
        full.append((f, n, a, "str" if s is not None else "json" if isinstance(v, str) else "int" if isinstance(v, int) else "float", s,
                     v if isinstance(v, int) else None, v if isinstance(v, float) else None, None, v if isinstance(v, str) and s is None else None))
    return spark.createDataFrame(full, SCHEMAS["attributes"])


@pytest.fixture(scope="module")
def cat(spark):
    rows = [("f", "/", None, "group", None, None, None), ("f", "/grp", "/", "group", None, None, None), ("f", "/dataset", "/", "dataset", "float64", 0, []),
            ("f", "/half", "/", "dataset", "float64", 0, []), ("f", "/random", "/", "dataset", "int64", 1, [3]), ("f", "/grp/u", "/grp", "dataset", "float64", 2, [4, 2])]
    attrs = [("f", "/", "title", "root title"), ("f", "/", "tag", "root"), ("f", "/grp", "a", 1), ("f", "/grp", "b", '{"c": 2, "d": {"e": "x"}}'), ("f", "/grp", "tag", "group"),
             ("f", "/dataset", "a", 1), ("f", "/dataset", "units", "m"), ("f", "/dataset", "tag", "dataset"), ("f", "/half", "units", "m/s"),
             ("f", "/random", "units", "m/s"), ("f", "/random", "tag", "dataset"), ("f", "/grp/u", "x.y", 3.5)]
    values = spark.createDataFrame([("f", "/half", None, None, None, 0.5, None), ("f", "/dataset", None, None, None, 7.0, None)]
                                   + [("f", "/random", i, None, None, float(i + 1), None) for i in range(3)], SCHEMAS["values"])
    notes = spark.createDataFrame([("f", "/grp", "obj", "a", "http://s/1", ["http://c/A"], "http://p/first", "http://o/1", "iri"),
                                   ("f", "/half", "obj", "units", "http://s/2", ["http://c/A"], "http://p/first", None, None)], SCHEMAS["rdf_annot"])
    return Catalogue(objects(spark, rows).cache(), attributes(spark, attrs).cache(), values, notes)


def names(df):
    return sorted(r["name"] for r in df.select("name").collect())


@pytest.mark.parametrize(("flt", "kind", "expected"), [
    ({"title": "root title"}, None, ["/"]), ("title", None, ["/"]), ({"a": 1}, None, ["/dataset", "/grp"]), ({"a": 1}, "dataset", ["/dataset"]),
    ({"b.c": 2}, None, ["/grp"]), ({"b.d.e": "x"}, None, ["/grp"]), ({"b.c": 3}, None, []), ({"x.y": {"$gt": 3}}, None, ["/grp/u"]),
    ({"units": {"$in": ["m", "s"]}}, None, ["/dataset"]), ({"a": {"$in": [1, 5]}}, "$group", ["/grp"]), ({"units": {"$regex": "/s"}}, None, ["/half", "/random"]),
    ({"$basename": "u"}, None, ["/grp/u"]), ({"$basename": "r.*m"}, None, ["/random"]), ({"units": {"$exists": False}}, "dataset", ["/grp/u"]),
    ({"units": {"$exists": True}}, None, ["/dataset", "/half", "/random"]), ({"$shape": (3,)}, None, ["/random"]), ({"$ndim": 0}, None, ["/dataset", "/half"]),
    ({"$ndim": {"$gt": 0}}, None, ["/grp/u", "/random"]), ({"$ndim": {"$gte": 1}}, None, ["/grp/u", "/random"]), ({"$eq": 0.5}, None, ["/half"]),
    ({"$gte": 0.5}, None, ["/dataset", "/half"]), ({"$lt": 0.5}, None, []), ({"$eq": [1, 2, 3]}, None, ["/random"]), ({"$eq": [1, 2]}, None, []),
    ({"$mean": {"$eq": 2.0}}, None, ["/random"]), ({}, "group", ["/", "/grp"]), (["a", "units"], None, ["/dataset"]), ({"nope": 1}, None, []),
    ({"units": lambda c: F.length(c) == 1}, None, ["/dataset"]), ({"a": 1, "b": {"$exists": True}}, None, ["/grp"]),
    ({"units": {"$exists": False}, "a": 1}, None, ["/grp"]), ({"$compression": "gzip"}, None, [])])
def test_find(cat, flt, kind, expected):
    assert names(filters.find(cat, flt, kind)) == expected


def test_several_operators_under_one_key(cat):
    assert names(filters.find(cat, {"$ndim": {"$lt": 1, "$gt": 1}})) == ["/dataset", "/grp/u", "/half"]
    assert names(filters.find(cat, {"$ndim": {"$gte": 1, "$lt": 2}}, match="all")) == ["/random"]
    assert names(filters.find(cat, {"tag": {"$eq": "root", "$regex": "^gro"}})) == ["/", "/grp"]


def test_scope_children_and_firsts(cat):
    assert names(filters.find(cat, {}, base="/grp")) == ["/grp", "/grp/u"]
    assert names(filters.find(cat, {}, recursive=False)) == ["/dataset", "/grp", "/half", "/random"]
    assert names(filters.find_one(cat, {"a": 1})) == ["/dataset"]
    assert names(filters.list_children(cat.objects, "dataset", "^[dh]")) == ["/dataset", "/half"]
    assert filters.has_children(cat.objects, "/grp").first()[1:] == (True, False)
    with pytest.raises(ValueError):
        filters.kind_of("table")


def test_distinct_and_annotations(cat):
    values = lambda df: sorted(r["value"] for r in df.collect())
    assert values(filters.distinct_values(cat, "tag")) == ["dataset", "group", "root"]
    assert values(filters.distinct_values(cat, "units", "dataset")) == ["m", "m/s"]
    assert values(filters.distinct_values(cat, "$shape")) == ["", "3", "4,2"]
    assert names(filters.rdf_find(cat, predicate="http://p/first")) == ["/grp", "/half"]
    assert names(filters.rdf_find(cat, subject="http://s/1", type="http://c/A")) == ["/grp"]
    assert names(filters.rdf_find(cat, type="http://c/B")) == []
    assert names(filters.rdf_find(cat, object="m")) == ["/dataset"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(low=st.integers(-2, 3), high=st.integers(-2, 3))
def test_laws(cat, low, high):
    a, b = {"$ndim": {"$gte": low}}, {"$size": {"$lte": high}}
    assert names(filters.find(cat, a | b)) == sorted(set(names(filters.find(cat, a))) & set(names(filters.find(cat, b))))
    have, lack = ({"units": {"$exists": x}} for x in (True, False))
    assert sorted(names(filters.find(cat, have)) + names(filters.find(cat, lack))) == names(cat.objects)
