import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treelake.model import EX, LABEL, RDFS, SCHEMAS, TYPE, XSD
from treelake.operators import connectivity, metrics, neighborhood, shapes
from treelake.operators import patterns as P
from treelake.operators.filters import first_per

B = "https://example.org/"


def graph(spark, rows, name="g"):
    full = []
    for s, p, o, *more in rows:
        kind = more[0] if more else "iri"
        full.append((name, s, "bnode" if s.startswith("_") else "iri", p, o, kind, *(more[1:] + [None] * (3 - len(more)))[:2]))
    return spark.createDataFrame(full, SCHEMAS["triples"])


@pytest.fixture(scope="module")
def planets(spark):
    rows = []
    for name, mass, radius in (("Mercury", 3.3e23, 2439700.0), ("Venus", 4.87e24, 6051800.0), ("Earth", 5.97e24, 6371000.0), ("Jupiter", 1.9e27, 69911000.0)):
        s = B + name
        rows += [(s, TYPE, B + "Planet"), (s, LABEL, name, "lit", None, "en"), (s, B + "mass", str(mass), "lit", XSD + "double"), (s, B + "radius", str(radius), "lit", XSD + "double")]
    rows += [(B + "Ceres", TYPE, B + "Asteroid"), (B + "Ceres", B + "mass", "9.4e20", "lit", XSD + "double")]
    return graph(spark, rows).cache()


def test_planets(planets):
    bound = P.bgp(planets, [("?s", TYPE, B + "Planet"), ("?s", LABEL, "?l"), ("?s", B + "mass", "?m"), ("?s", B + "radius", "?r")])
    made = P.construct(bound, [("?s", TYPE, B + "Planet", "iri"), ("?s", LABEL, "?l", "lit"), ("?s", B + "mass", "?m", "lit"), ("?s", B + "radius", "?r", "lit")])
    assert made.count() == 16
    heavy = bound.where(F.col("m").try_cast("double") > 1e24).orderBy(F.col("m").cast("double").desc())
    assert [r.l for r in heavy.collect()] == ["Jupiter", "Earth", "Venus"]
    assert float(bound.where("l = 'Earth'").first().r) == 6371000.0
    assert P.star(planets, "s", {"m": B + "mass", "r": B + "radius"}).count() == 4
    assert P.optional(P.match(planets, ("?s", B + "mass", "?m")), P.match(planets, ("?s", LABEL, "?l"))).where("l is null").count() == 1
    assert P.without(P.match(planets, ("?s", B + "mass", "?m")), P.match(planets, ("?s", LABEL, "?l"))).first().s == B + "Ceres"
    assert P.ask(P.match(planets, ("?s", TYPE, B + "Comet"))).first().answer is False
    assert P.describe(planets, planets.where(F.col("o") == "Earth").select("s"), B + "Planet", TYPE).count() == 4
    with pytest.raises(ValueError):
        P.join(P.match(planets, ("?a", TYPE, "?b")), P.match(planets, ("?c", LABEL, "?d")))


def test_union_is_a_set(planets):
    assert P.union_graphs(planets, planets).count() == planets.count()


def test_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "s string, o string")
    got = {(r.start, r.node) for r in P.closure(e, spark.createDataFrame([("a",), ("y",)], "start string")).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("y", "y")}
    both = P.closure(e, spark.createDataFrame([("y",)], "start string"), both_ways=True)
    assert {r.node for r in both.collect()} == {"x", "y"}


def test_below_by_names(spark):
    names = ["/", "/a", "/a/b", "/a/b/c", "/a-b", "/ab/a"]
    objects = spark.createDataFrame([("f", n) for n in names] + [("g", "/a/x")], "file_id string, name string")
    starts = spark.createDataFrame([("f", "/a"), ("f", "/a/b"), ("f", "/"), ("f", "/a"), ("f", "/none")], "file_id string, start string")
    got = {(r.start, r.name) for r in P.below(objects, starts).collect()}
    assert got == {("/", n) for n in names} | {("/a", n) for n in ("/a", "/a/b", "/a/b/c")} | {("/a/b", n) for n in ("/a/b", "/a/b/c")}


def test_metrics_small(spark):
    g = graph(spark, [(B + "a", TYPE, B + "Class"), (B + "a", LABEL, "A", "lit"), (B + "a", B + "linksTo", B + "b")])
    assert metrics.graph_counts(g).first().asDict() == {"triples": 3, "subjects": 1, "predicates": 3, "objects": 3}
    assert metrics.coverage(g).first().label_coverage == 100.0
    assert metrics.largest_distance(g).first().asDict() == {"largest_distance": 2, "computed": True, "resource_nodes": 3}
    assert {r.label: r.n for r in metrics.external_namespaces(g, B).collect()} == {TYPE[:-4]: 1, RDFS: 1}
    empty = g.limit(0)
    assert metrics.coverage(empty).first().type_coverage == 0.0 and metrics.subject_stats(empty).first()[0] == 0.0
    assert metrics.largest_distance(empty).first().largest_distance == 0


def test_distance_gate_and_blank_nodes(spark):
    g = graph(spark, [(f"_:{i}" if i == 2 else f"{B}{i}", B + "next", f"{B}{i + 1}" if i != 1 else "2", "bnode" if i == 1 else "iri") for i in range(4)])
    g = g.withColumn("s", F.regexp_replace("s", "^_:", ""))
    got = metrics.largest_distance(g, limit=3).first()
    assert got.largest_distance is None and not got.computed and got.resource_nodes == 5
    assert metrics.largest_distance(g).first().largest_distance == 4
    assert metrics.degree_summary(g).first().blank_nodes == 1 and metrics.graph_terms(g).first().blank_nodes == 1
    assert metrics.degree_summary(g).first().weakly_connected == 2


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [(f"m{rng.randrange(90)}", f"m{rng.randrange(90)}") for _ in range(60)] + [("hub", f"leaf{i}") for i in range(40)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = metrics.components(spark.createDataFrame(edges, "s string, o string"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for e in edges for x in e}


def test_components_of_each_graph_with_hubs(spark):
    """The same names in several graphs; a hub, a long chain, loops and nodes without edges."""
    edges = [("g", "hub", f"x{i}") for i in range(300)] + [("h", f"x{i}", f"x{i + 1}") for i in range(0, 60, 2)] + [("h", f"c{i:03}", f"c{i + 1:03}") for i in range(100)]
    edges += [("g", "self", "self"), ("h", "x1", "x1")]
    df = spark.createDataFrame(edges, "graph string, s string, o string")
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for g, a, b in edges:
        a, b = find((g, a)), find((g, b))
        root[max(a, b)] = min(a, b)
    got = {(r.graph, r.node): (r.graph, r.root) for r in connectivity.components(df, "graph").collect()}
    assert got == {(g, x): find((g, x)) for g, *e in edges for x in e}
    alone = spark.createDataFrame([("n", "q", 1), ("n", "p", 1), ("n", "lone", 0)], "graph string, node string, n long")
    some = connectivity.components(spark.createDataFrame([("n", "p", "q")], "graph string, s string, o string"), "graph", alone)
    assert {(r.node, r.root) for r in some.collect()} == {("p", "p"), ("q", "p"), ("lone", "lone")}


def test_diameter_against_all_searches():
    rng = random.Random(4)
    for _ in range(60):
        edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 70))] + [(100 + i, 101 + i) for i in range(rng.randrange(1, 9))]
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        longest = 0
        for start in near:
            dist, queue = {start: 0}, [start]
            for x in queue:
                for y in near[x]:
                    if y not in dist:
                        dist[y] = dist[x] + 1
                        queue.append(y)
            longest = max(longest, *dist.values())
        s, o = (np.array([str(e[k]) for e in edges if e[0] != e[1]]) for k in (0, 1))
        assert connectivity.diameter(s, o) == longest


def test_measures_of_each_graph(spark):
    a = graph(spark, [(B + "a", TYPE, B + "Class"), (B + "b", TYPE, B + "Class"), (B + "a", B + "next", B + "b"), (B + "x", B + "next", B + "y")])
    b = graph(spark, [(B + "a", LABEL, "A", "lit", None, "en"), (B + "a", LABEL, "B", "lit", XSD + "string")])
    both = a.withColumn("graph", F.lit("one")).unionByName(b.withColumn("graph", F.lit("two")))
    got = {r.graph: r for r in metrics.graph_metrics(both, B, per_graph=True, distance_limit=4).collect()}
    assert (got["one"].triples, got["one"].components, got["one"].largest_component, got["one"].largest_distance) == (4, 2, 3, None)
    assert (got["two"].triples, got["two"].components, got["two"].largest_distance, got["two"].label_coverage) == (2, 1, 0, 100.0)
    assert [tuple(x) for x in got["one"].top_in_degree] == [("Class", 2), ("b", 1), ("y", 1)]
    assert [tuple(x) for x in got["one"].top_classes] == [("Class", 2)] and got["two"].top_out_degree == []
    lists = {(r.graph, r.list, r.place): (r.label, r.n) for r in metrics.graph_lists(both, B).collect()}
    assert lists["two", "languages", 1] == ("None", 1) and lists["two", "languages", 2] == ("en", 1) and lists["two", "datatypes", 2] == ("xsd:string", 1)
    assert lists["one", "rare_predicates", 1] == ("next", 2) and lists["one", "top_external_namespaces", 1] == (TYPE[:-4], 2)
    # Above the limit there is no answer, whatever a caller sets.
    chain = graph(spark, [(f"{B}{i}", B + "next", f"{B}{i + 1}") for i in range(12)])
    assert metrics.largest_distance(chain, limit=12).first().largest_distance is None and metrics.largest_distance(chain, limit=13).first().largest_distance == 12


def test_literals(spark):
    g = graph(spark, [("a", "p", "x", "lit"), ("a", "p", "x", "lit"), ("a", "p", " ", "lit", None, "en"), ("a", "p", "1", "lit", XSD + "integer"), ("a", "q", "", "lit"),
                      ("a", "http://www.w3.org/2002/07/owl#sameAs", "b")])
    assert metrics.literal_quality(g).first().asDict() == {"literals": 5, "untyped": 3, "empty": 1, "same_as": 1, "duplicates": 1}
    assert {r.label: r.n for r in metrics.literal_distribution(g, "o_dt").collect()} == {"None": 4, "xsd:integer": 1}


def test_neighborhood(spark):
    g = graph(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"), ("x", "p", "a"), ("a", TYPE, EX + "C"), ("a", LABEL, "Needle", "lit"), ("z", "p", "z2")])
    pairs = lambda df: {(r.s, r.o) for r in df.collect()}
    assert pairs(neighborhood.around(g, "a", 1, "out")) == {("a", "b")}
    assert pairs(neighborhood.around(g, "a", 1, "in")) == {("x", "a")}
    assert pairs(neighborhood.around(g, "a", 2)) == {("a", "b"), ("b", "c"), ("x", "a")}
    assert pairs(neighborhood.search(g, "needle")) == {("a", "b"), ("x", "a"), ("a", EX + "C")}
    assert pairs(neighborhood.search(g, "Z2")) == {("z", "z2")}
    assert pairs(neighborhood.around(g, "needl", 1, "out")) == {("a", "b")}
    both = graph(spark, [("hub", "p", "m"), ("hub", "p", "n"), ("m", "p", "n"), ("n", "p", "far")])
    assert pairs(neighborhood.search(both, "hub")) == {("hub", "m"), ("hub", "n"), ("m", "n")}
    alone = neighborhood.most_connected(neighborhood.edges(both), nodes=1).collect()
    assert [(r.s, r.total_nodes, r.total_edges, r.truncated) for r in alone] == [(None, 4, 4, True)]
    e = neighborhood.edges(g, with_terms=False)
    top = neighborhood.most_connected(e, nodes=3, edges=1).collect()
    assert len(top) == 1 and top[0].truncated and top[0].total_nodes == 7 and top[0].total_edges == 5
    nodes = {r.node: r for r in neighborhood.node_table(g, e, e.where("s = 'a'")).collect()}
    assert nodes["a"]["class"] == "C" and (nodes["a"].degree, nodes["a"].shown, nodes["a"].hidden) == (2, 1, 1)


def test_all_measures_in_one_row(spark):
    g = graph(spark, [(B + "a", TYPE, B + "Class"), (B + "a", LABEL, "A", "lit"), (B + "a", B + "linksTo", B + "b"), (B + "c", B + "note", "", "lit"),
                      (B + "c", "http://www.w3.org/2002/07/owl#sameAs", B + "c"), (B + "c", B + "note", "", "lit")])
    got = metrics.graph_metrics(g, B).first().asDict()
    assert {k: got[k] for k in ("triples", "subjects", "predicates", "objects", "iri_count", "literals", "classes", "subjects_without_type")} == {
        "triples": 6, "subjects": 2, "predicates": 5, "objects": 5, "iri_count": 9, "literals": 3, "classes": 1, "subjects_without_type": 1}
    assert (got["duplicate_triples"], got["same_as_count"], got["empty_literals"], got["label_coverage"]) == (1, 1, 2, 50.0)
    assert (got["components"], got["largest_component"], got["largest_distance"], got["external_iri_count"]) == (2, 3, 2, 3)
    assert (got["resource_nodes"], got["weakly_connected_nodes"], got["avg_out_degree"]) == (4, 2, 0.75)
    empty = metrics.graph_metrics(g.limit(0)).first()
    assert (empty.triples, empty.components, empty.largest_component, empty.label_coverage, empty.avg_out_degree) == (0, 0, 0, 0.0, 0.0)


def test_views_by_detail(spark, monkeypatch):
    monkeypatch.setattr(neighborhood, "DETAIL", {"compact": (2, 1), "balanced": (5, 1), "detailed": (7, 5), "full": (None, None)})
    g = graph(spark, [(f"{B}node-{i}", B + "linksTo", f"{B}node-{i + 1}") for i in range(6)] + [(B + "alone", B + "note", "text", "lit")])
    one = lambda **how: neighborhood.view(g, **how).summary.first().asDict()
    got = one(detail="balanced")
    assert (got["shown_nodes"], got["shown_edges"], got["dropped_isolated"], got["truncated"]) == (2, 1, 3, True)
    assert one(detail="balanced", isolated=True)["shown_nodes"] == 5 and one(detail="compact")["shown_edges"] == 1 and one(detail="detailed")["shown_edges"] == 5
    full = neighborhood.view(g, "full")
    assert full.summary.first().asDict() == {"total_nodes": 8, "shown_nodes": 8, "total_edges": 6, "shown_edges": 6, "dropped_isolated": 0, "truncated": False}
    nodes = {r.label: (r.degree, r.shown, r.hidden) for r in neighborhood.view(g, "balanced").nodes.collect()}
    assert len(nodes) == 2 and all(d == s + h for d, s, h in nodes.values())
    with pytest.raises(ValueError):
        neighborhood.view(g, "huge")


def test_a_view_names_only_nodes_near_its_limit(spark, monkeypatch):
    """Links are counted by hashes; of the other nodes none is written or counted by name, and repeats count once."""
    written, settle = [], neighborhood.settle

    def noted(df):
        out = settle(df)
        written.extend([out.count()] * ("string" in dict(out.dtypes).values()))
        return out

    monkeypatch.setattr(neighborhood, "DETAIL", {"compact": (3, 10)})
    monkeypatch.setattr(neighborhood, "settle", noted)
    rows = [(f"{B}n{i}", B + "linksTo", f"{B}hub{i % 3}") for i in range(300)] + [(B + "hub0", B + "linksTo", B + "hub1"), (B + "hub1", TYPE, B + "Hub")]
    # A link that is said often raises its ends' counts, but no degree; a literal is no link.
    rows += [(B + "n5", B + "linksTo", B + "n6")] * 300 + [(B + "n7", B + "note", str(i), "lit") for i in range(300)]
    view = neighborhood.view(graph(spark, rows), "compact")
    got = {tuple(r) for r in view.nodes.collect()}
    assert got == {(B + "hub0", "hub0", "Resource", 101, 1, 100), (B + "hub1", "hub1", "Hub", 102, 1, 101)} and max(written) <= 10
    assert view.summary.first().asDict() == {"total_nodes": 304, "shown_nodes": 2, "total_edges": 1, "shown_edges": 1, "dropped_isolated": 1, "truncated": True}


def test_a_view_is_right_where_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(neighborhood, "DETAIL", {"compact": (3, 6)})
    rng = random.Random(5)
    node = lambda: rng.choice("_" * (rng.random() < 0.2) + "a") + str(min(rng.randrange(25), rng.randrange(25)))
    rows = [(node(), "p" + str(rng.randrange(2)), node()) for _ in range(90)] + [(node(), "p", "x", "lit") for _ in range(30)] + [("lone", "p", "x", "lit")]
    rows = [(s, p, o, *(more or ["bnode" if o.startswith("_") else "iri"])) for s, p, o, *more in rows]
    g = graph(spark, rows * 2 + rows[:40] * 3).cache()
    links = {r[:3] for r in rows if r[3] != "lit"}
    degree = {n: sum((s == n) + (o == n) for s, _, o in links) for r in links for n in (r[0], r[2])}
    top = sorted(degree, key=lambda n: (-degree[n], n))[:3]
    inside = [x for x in links if x[0] in top and x[2] in top]
    shown = {n: sum((s == n) + (o == n) for s, _, o in sorted(inside)[:6]) for n in top}
    rounds, distinct_rows = [], neighborhood.distinct_rows
    monkeypatch.setattr(neighborhood, "distinct_rows", lambda df: rounds.append(1) or distinct_rows(df))
    for groups, isolated in ((4, False), (11, True)):
        monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(F.crc32(F.col(c[0]).cast("binary")), F.lit(groups)))
        got = neighborhood.view(g, "compact", isolated)
        assert {r.node: (r.degree, r.shown) for r in got.nodes.collect()} == {n: (degree[n], shown[n]) for n in top if shown[n] or isolated}
        totals = got.summary.first()
        assert (totals.total_nodes, totals.total_edges) == (len(degree | {r[0]: 0 for r in rows} if isolated else degree), len(inside))
    assert len(rounds) > 2


def test_namespaces_and_classes_of_a_view(spark):
    g = graph(spark, [("http://a#x", "http://p/q", "http://b/y"), ("_n", "http://p/q", "http://b/z"), ("http://a#x", "http://p/q", "text", "lit")])
    got = {r.group: (r.namespace, r.nodes) for r in neighborhood.namespace_groups(g, {"b": "http://b/"}).collect()}
    assert got == {"http://a#": ("http://a#", 1), "b": ("http://b/", 2), "blank": ("blank", 1)}
    nodes = spark.createDataFrame([("a", "C", 3, 1), ("b", "C", 2, 0), ("c", "D", 1, 1)], "node string, class string, degree long, hidden long")
    assert {tuple(r) for r in neighborhood.class_index(nodes).collect()} == {("C", 2, 5, 1), ("D", 1, 1, 1)}


def test_first_of_each_key(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "k string, at int, v string")
    assert {(r.k, r.v) for r in first_per(df, ["k"], ["at"]).collect()} == {("a", "x"), ("b", "z")}


def test_messages_and_conformity(spark):
    g = graph(spark, [("q", B + "unit", "m")])
    shape = shapes.Shape("q", subjects_of=B + "unit", properties=[shapes.Property(B + "title", 1, message="A title is needed."), shapes.Property(B + "unit", max_count=1)],
                         not_exists=B + "unit", message="No unit here.")
    found = shapes.validate(g, [shape])
    assert {(r.component, r.message) for r in found.collect()} == {("minCount", "A title is needed."), ("notExists", "No unit here.")}
    assert shapes.conforms(found).first().conforms is False
    assert shapes.conforms(shapes.validate(g, [shapes.Shape("e", target_nodes=["q"])])).first().conforms is True


def test_shapes_with_subclasses(spark):
    unit = graph(spark, [("m", TYPE, B + "LengthUnit"), ("q", B + "unit", "m"), ("q", B + "created", "2024", "lit", XSD + "string")])
    shape = shapes.Shape("q", target_nodes=["q"], properties=[shapes.Property(B + "unit", of_class=B + "Unit", node_kind="iri", min_count=1)])
    assert [r.component for r in shapes.validate(unit, [shape]).collect()] == ["class"]
    ontology = spark.createDataFrame([(B + "LengthUnit", RDFS + "subClassOf", B + "Unit")], "s string, p string, o string")
    assert shapes.validate(unit, [shape], ontology).count() == 0
    dated = shapes.Shape("d", subjects_of=B + "unit", properties=[shapes.Property(B + "created", 1, 1, datatype=XSD + "date"), shapes.Property(B + "title", 1)], not_exists=B + "bad")
    assert sorted(r.component for r in shapes.validate(unit, [dated]).collect()) == ["datatype", "minCount"]
    two = unit.union(graph(spark, [("m2", TYPE, B + "Unit"), ("q2", B + "unit", "m2")], "h"))
    typed = shapes.Shape("u", subjects_of=B + "unit", properties=[shapes.Property(B + "unit", of_class=B + "Unit")])
    assert {r.graph for r in shapes.validated_load(two, [typed]).collect()} == {"h"}


def test_hubs_leave_few_edges_to_components(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"n{i}", "class") for i in range(400)] + [(f"n{i}", f"p{rng.randrange(60)}") for i in range(400) for _ in range(4)]
    edges += [(f"x{i}", f"x{i + 1}") for i in range(30)] + [("y1", "y2"), ("y2", "y2")]
    monkeypatch.setattr(connectivity, "HUBS", 3)
    given, stars = [], connectivity.stars
    monkeypatch.setattr(connectivity, "stars", lambda e, *a: given.append(e.distinct().count()) or stars(e, *a))
    got = {r.node: r.root for r in connectivity.components(spark.createDataFrame(edges, "s string, o string")).collect()}
    want = {n: ("class" if n[0] in "npc" else "x0" if n[0] == "x" else "y1") for e in edges for n in e}
    assert got == want and given[0] < 150


def test_edges_of_a_large_graph_are_not_gathered_for_distances(spark, monkeypatch):
    edges = spark.createDataFrame([("large", f"n{i}", f"n{i + 1}") for i in range(50)] + [("small", "a", "b"), ("small", "b", "c")], "graph string, s string, o string")
    sizes = spark.createDataFrame([("large", 51), ("small", 3), ("alone", 1)], "graph string, resource_nodes long")
    monkeypatch.setattr(connectivity, "settle", lambda df: df, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = connectivity.distances(edges, sizes, "graph", 10)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in out.collect()} == {("large", 51, None, False), ("small", 3, 2, True), ("alone", 1, 0, True)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan


def test_report_makes_violations_distinct_not_their_triples(spark):
    schema = "shape string, focus string, path string, value string, component string, message string"
    one = ("s", "http://f", "http://p", None, "minCount")
    out = shapes.report(spark.createDataFrame([(*one, "a"), (*one, "a"), (*one, "b"), ("s", "http://g", "http://p", "7", "datatype", "c")], schema))
    assert "distinct" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()).lower() and "Aggregate [s#" not in plan
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and sorted(r[2] for r in rows if r[1].endswith("resultMessage")) == ["a", "b", "c"]


def test_the_union_of_two_graphs_moves_repeated_rows_only(spark, monkeypatch):
    from treelake import skew
    from treelake.operators import triples as T

    schema = "s string, p string, o string, o_kind string, o_dt string"
    rows = [(f"s{i}", "p", f"o{i}", "lit", None) for i in range(50)]
    one = spark.createDataFrame(rows + rows[:3] + [("s", "p", None, "lit", None)] * 2, schema)
    two = spark.createDataFrame(rows[10:14] + [("s0", "p", "o0", "lit", "d")], schema)
    want = sorted(map(str, set(rows) | {("s", "p", None, "lit", None), ("s0", "p", "o0", "lit", "d")}))
    calls, settle = [], skew.settle
    monkeypatch.setattr(skew, "settle", lambda df: calls.append(df.count()) or settle(df))
    assert sorted(str(tuple(r)) for r in T.select_graph(one, two).collect()) == want
    assert calls == [60, 8]  # the rows, then the hashes that repeat
    monkeypatch.setattr(skew, "SMALL", 0)
    assert sorted(str(tuple(r)) for r in T.select_graph(one, two).collect()) == want
