import json

import pytest
from pyspark.sql import functions as F
from test_filters import attributes, objects

from treelake.model import Catalogue
from treelake.operators import convention, layout, shapes
from treelake.operators.convention import Rule
from treelake.operators.layout import Spec


@pytest.fixture(scope="module")
def arrays(spark):
    rows = [("f", "/", None, "group", None, None, None), ("f", "/a", "/", "dataset", "float32", 2, [1, 1]), ("f", "/b", "/", "dataset", "float32", 2, [1, 1]),
            ("f", "/c", "/", "dataset", "float64", 3, [1, 1, 1]), ("f", "/d", "/", "dataset", "float64", 3, [1, 1, 1])]
    attrs = [("f", "/a", "units", "m"), ("f", "/b", "units", "nonsense"), ("f", "/c", "units", "km/s"), ("f", "/a", "comment", "Fine text")]
    return Catalogue(objects(spark, rows).cache(), attributes(spark, attrs).cache())


def flags(cat, *specs):
    return sorted((r.spec, r.target, r.n_hits, r.flag) for r in layout.validate(cat, list(specs)).collect())


def test_counts(arrays):
    two = {"$ndim": 2}
    for n, flag in ((2, 1), (1, 10), ({"$gt": 1}, 1), ({"$gt": 2}, 10), ({"$gte": 2}, 1), (None, 17)):
        assert flags(arrays, Spec("s", two, "dataset", n=n)) == [("s", "/", 2, flag)]
    for bad in (-2, 0, {"$about": 2}):
        with pytest.raises(ValueError):
            Spec("s", two, n=bad)


def test_alternatives_and_sub_specifications(arrays):
    none, all_ = {"$ndim": 9}, {"$ndim": {"$gte": 2}}
    assert flags(arrays, Spec("s", none, n=2, alternatives=[Spec("t", {"$ndim": 3})])) == [("s", "/", 2, 5)]
    assert flags(arrays, Spec("s", none, n=1, alternatives=[Spec("t", {"$ndim": 3})])) == [("s", "/", 2, 14)]
    below = Spec("s", all_, "dataset", n=4, then=[Spec("f32", {"$dtype": "float32"}, n=2, rebase=True), Spec("kids", {}, n=1)])
    got = flags(arrays, below)
    assert ("f32", "/", 2, 1) in got and sum(x[0] == "kids" for x in got) == 4 and all(x[3] == 10 for x in got if x[0] == "kids")
    assert flags(arrays, Spec("s", none, then=[Spec("never", {}, n=1)])) == [("s", "/", 0, 17)]
    rows = layout.summary(layout.validate(arrays, [Spec("s", none, n=1)]))
    assert rows.first().text == "FAILED|INVALID_NUMBER" and layout.is_valid(rows).first().valid is False and layout.failed(rows).count() == 1


def test_convention(arrays):
    rules = [Rule("units", "dataset", "units"), Rule("comment", "dataset", "regex", "[A-Z].*", obligatory=False), Rule("title", "file", alternative="units"),
             Rule("comment", "group", obligatory=False)]
    got = {(r.name, r.attr, r.problem) for r in convention.validate(arrays, rules).collect()}
    assert got == {("/b", "units", "invalid"), ("/d", "units", "missing"), ("/", "title", "missing")}
    needs = [Rule("comment", "dataset", "str", obligatory=False, requires=["author"])]
    assert [(r.name, r.problem) for r in convention.validate(arrays, needs).collect()] == [("/a", "requires author")]


def test_string_datasets_are_left_alone(spark):
    cat = Catalogue(objects(spark, [("f", "/s", "/", "dataset", "str", 0, []), ("f", "/n", "/", "dataset", "int8", 0, [])]), attributes(spark, [("f", "/x", "y", "z")]))
    got = convention.validate(cat, [Rule("units", "dataset", "units", numeric_only=True)]).collect()
    assert [r.name for r in got] == ["/n"]


def test_convention_from_its_configuration(arrays, tmp_path):
    config = {"__name__": "c", "$kinds": ["m", "km/s"], "units": {"target_method": "create_dataset", "validator": "$kinds"},
              "comment-dataset": {"target_method": "create_dataset", "validator": "$regex(^[A-Z].*$)", "default_value": "$NONE", "requirements": ["author"]},
              "title": {"target_method": "__init__", "validator": "str", "alternative_standard_attribute": "long_title"},
              "note": {"target_method": "create_group", "default_value": "nothing"}}
    rules = convention.from_config(config)
    assert rules == [Rule("units", "dataset", "in", ["m", "km/s"]), Rule("comment", "dataset", "regex", "^[A-Z].*$", obligatory=False, requires=["author"]),
                     Rule("title", "file", alternative="long_title"), Rule("note", "group", obligatory=False)]
    got = {(r.name, r.attr, r.problem) for r in convention.validate(arrays, rules).collect()}
    assert got == {("/b", "units", "invalid"), ("/d", "units", "missing"), ("/a", "comment", "requires author"), ("/", "title", "missing")}
    (tmp_path / "c.yaml").write_text(json.dumps(config))
    assert convention.from_yaml(str(tmp_path / "c.yaml")) == rules
    for bad in ({"x": {"target_method": "create_table"}}, {"x": {"target_method": "create_group", "validator": "$unheard"}}):
        with pytest.raises(ValueError):
            convention.from_config(bad)


def test_validators_of_the_caller(arrays):
    convention.register("short", lambda c, arg: F.length(c) <= arg)
    got = convention.validate(arrays, [Rule("units", "dataset", "short", 4, obligatory=False)]).collect()
    assert [(r.name, r.problem) for r in got] == [("/b", "invalid")]


def test_filters_of_a_tree_are_scanned_once(arrays):
    """However many specifications there are, the catalogue is read by one scan of each table and the roots' own."""
    specs = [Spec(f"s{k}", {"$ndim": k, "units": {"$regex": "m"}}, "dataset", then=[Spec(f"t{k}", {"comment": {"$exists": False}})]) for k in range(1, 4)]
    plan = layout.validate(arrays, specs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 4


def test_report_as_triples(spark):
    rows = [("s", "http://f", "http://p", "http://v", "class", "no"), ("s", "http://f", "http://p", None, "minCount", "none")]
    v = spark.createDataFrame(rows, "shape string, focus string, path string, value string, component string, message string")
    got = [(r.p.rsplit("#", 1)[-1], r.o, r.o_kind) for r in shapes.report(v).collect()]
    assert ("conforms", "false", "lit") in got and sum(p == "result" for p, *_ in got) == 2 and got.count(("value", "http://v", "iri")) == 1
    assert ("sourceConstraintComponent", shapes.SH + "MinCountConstraintComponent", "iri") in got
    assert [(r.p.rsplit("#", 1)[-1], r.o) for r in shapes.report(v.limit(0)).collect() if r.o_kind == "lit"] == [("conforms", "true")]
