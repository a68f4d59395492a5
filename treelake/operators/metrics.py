"""Measures of a graph; each is one grouping unless it says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.functions.paths import namespace, term_label
from treelake.lineage import settle
from treelake.model import LABEL, OWL, TYPE
from treelake.operators.connectivity import DISTANCE_LIMIT, components, distances


def _is_resource() -> Column:
    return F.col("o_kind").isin("iri", "bnode")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(100.0 * a / b, 6)).otherwise(0.0)


def terms(triples: DataFrame) -> DataFrame:
    """(term, kind, dt, lang) of all three places, one row for each occurrence."""
    none = F.lit(None).cast("string")
    t = lambda term, kind, dt=none, lang=none: F.struct(term.alias("term"), kind.alias("kind"), dt.alias("dt"), lang.alias("lang"))
    places = F.array(t(F.col("s"), F.col("s_kind")), t(F.col("p"), F.lit("iri")), t(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")))
    return triples.select(F.explode(places).alias("x")).select("x.*")


def graph_counts(triples: DataFrame) -> DataFrame:
    """Triples and the distinct terms of each place: one grouping by term."""
    return _by_term(triples).agg(*[c.alias(n) for n, c in _term_counts().items() if n in ("triples", "subjects", "predicates", "objects")])


def _by_term(triples: DataFrame, by: str | None = None) -> DataFrame:
    """(kind, term, dt, lang) of each distinct term, in each graph if asked for, with what is counted of it; counts are pre-added
    before the shuffle."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    edge, is_ = _is_resource(), lambda p: (F.col("p") == p).cast("long")
    counts = ("subject", "predicate", "object", "out", "in_", "typed", "named", "class_")
    key = [by] if by else []

    def place(term: Column, kind: Column, dt: Column = none, lang: Column = none, **n: Column) -> Column:
        return F.struct(term.alias("term"), kind.alias("kind"), dt.alias("dt"), lang.alias("lang"),
                        *[n.get(c, zero).cast("long").alias(c) for c in counts])

    one = F.lit(1)
    rows = F.array(place(F.col("s"), F.col("s_kind"), subject=one, out=edge, typed=is_(TYPE), named=is_(LABEL)),
                   place(F.col("p"), F.lit("iri"), predicate=one),
                   place(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"), object=one, in_=edge, class_=is_(TYPE)))
    return triples.select(*key, F.explode(rows).alias("x")).select(*key, "x.*").groupBy(*key, "kind", "term", "dt", "lang").agg(*[F.sum(c).alias(c) for c in counts])


def _resource() -> Column:
    """Of a row by term: whether it is a node of the graph."""
    return (F.col("subject") > 0) | ((F.col("object") > 0) & (F.col("kind") != "lit"))


def _term_counts(base: str | None = None) -> dict[str, Column]:
    """Aggregates over :func:`_by_term`."""
    n = lambda test: F.count_if(test)
    total = lambda c, test=None: F.coalesce(F.sum(F.col(c) if test is None else F.when(test, F.col(c))), F.lit(0))
    kind, subject = F.col("kind"), F.col("subject") > 0
    lit, resource = kind == "lit", _resource()
    subjects, nodes = n(subject), n(resource)
    return {
        "triples": total("subject"), "subjects": subjects, "predicates": n(F.col("predicate") > 0), "objects": n(F.col("object") > 0),
        "iri_count": n(kind == "iri"), "blank_nodes": n(kind == "bnode"), "literals": total("object", lit),
        "untyped_literals": total("object", lit & F.col("dt").isNull() & F.col("lang").isNull()), "empty_literals": total("object", lit & (F.col("term") == "")),
        "avg_triples_per_subject": F.round(F.coalesce(total("subject") / F.nullif(subjects, F.lit(0)), F.lit(0.0)), 6),
        "classes": F.count_distinct(F.when(F.col("class_") > 0, term_label(F.col("term"), kind))),
        "subjects_without_type": n(subject & (F.col("typed") == 0)), "subjects_with_labels": n(subject & (F.col("named") > 0)),
        "subjects_missing_labels": n(subject & (F.col("named") == 0)), "label_coverage": _share(n(subject & (F.col("named") > 0)), subjects),
        "subjects_with_one_triple": n(F.col("subject") == 1), "resource_nodes": nodes,
        "avg_out_degree": F.round(F.coalesce(total("out") / F.nullif(nodes, F.lit(0)), F.lit(0.0)), 6),
        "avg_in_degree": F.round(F.coalesce(total("in_") / F.nullif(nodes, F.lit(0)), F.lit(0.0)), 6),
        "weakly_connected_nodes": n(resource & (F.col("in_") + F.col("out") <= 1)), "blank_node_percentage": _share(n(kind == "bnode"), nodes),
        "same_as_count": total("predicate", F.col("term") == OWL + "sameAs"),
        "external_iri_count": F.coalesce(F.sum(F.when(_outside(base), F.col("subject") + F.col("predicate") + F.col("object"))), F.lit(0)),
    }


def _outside(base: str | None) -> Column:
    return (F.col("kind") == "iri") & (F.lit(True) if base is None else ~F.col("term").startswith(base))


#: Lists that name the whole distribution, and those that name its greatest or least ten.
DISTRIBUTIONS = ("predicates", "datatypes", "languages")
TOPS = ("top_predicates", "rare_predicates", "top_classes", "top_external_namespaces", "top_out_degree", "top_in_degree")


def graph_lists(triples: DataFrame, base: str | None = None, per_graph: bool = True, terms: DataFrame | None = None, n: int = 10) -> DataFrame:
    """(graph, list, place, label, n): the distributions of predicates, datatypes and languages, and the ``n`` most frequent (rarest)
    predicates, classes by their instances, namespaces outside ``base``, and nodes by degree; ties by label, of nodes by their
    name too. Without ``per_graph`` all graphs are one, called ``*``. Heads of lists are taken before the shuffle, so no task
    sorts all nodes of a graph."""
    if not per_graph:
        triples = triples.withColumn("graph", F.lit("*"))
    if terms is None:
        terms = settle(_by_term(triples, "graph"))
    label = term_label(F.col("term"), F.col("kind"))
    entry = lambda df, name, label, count, tie=F.lit(None): df.select("graph", F.lit(name).alias("list"), label.alias("label"), count.alias("n"), tie.cast("string").alias("tie"))
    add = lambda df: df.groupBy("graph", "list", "label", "tie").agg(F.sum("n").alias("n"))
    predicates = add(entry(terms.where("predicate > 0"), "predicates", label, F.col("predicate")))
    lit = terms.where("kind = 'lit' and object > 0")
    datatypes = add(entry(lit, "datatypes", F.coalesce(term_label(F.col("dt"), F.lit("iri")), F.lit("None")), F.col("object")))
    languages = add(entry(lit, "languages", F.coalesce("lang", F.lit("None")), F.col("object")))
    typed = triples.where(F.col("p") == TYPE).select("graph", "s_kind", "s", term_label(F.col("o"), F.col("o_kind")).alias("label")).distinct()
    classes = add(entry(typed, "top_classes", F.col("label"), F.lit(1)))
    spaces = add(entry(terms.where(_outside(base)), "top_external_namespaces", namespace(F.col("term")), F.col("subject") + F.col("predicate") + F.col("object")))
    nodes = terms.where(_resource())
    degrees = entry(nodes.where("out > 0"), "top_out_degree", label, F.col("out"), F.col("term")).unionByName(
        entry(nodes.where("in_ > 0"), "top_in_degree", label, F.col("in_"), F.col("term")))
    renamed = lambda df, name: df.withColumn("list", F.lit(name))
    most = reduce(DataFrame.unionByName, [renamed(predicates, "top_predicates"), classes, spaces, degrees])
    heads = Window.partitionBy("graph", "list").orderBy(F.col("n").desc(), "label", "tie")
    rare = Window.partitionBy("graph", "list").orderBy("n", "label", "tie")
    whole = reduce(DataFrame.unionByName, [predicates, datatypes, languages]).withColumn("place", F.row_number().over(heads))
    first = lambda df, w: df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    out = whole.unionByName(first(most, heads)).unionByName(first(renamed(predicates, "rare_predicates"), rare))
    return out.select("graph", "list", "place", "label", "n")


def graph_metrics(triples: DataFrame, base: str | None = None, distance_limit: int = DISTANCE_LIMIT, per_graph: bool = False) -> DataFrame:
    """One row with every measure of all graphs taken together, or with ``per_graph`` one row for each graph, all in
    the same jobs. One grouping by term gives the counts, the nodes and the lists' entries; one of whole triples finds repeated ones;
    components and (up to ``distance_limit`` nodes) the largest distance come from the edges.

    Beside numbers a row has the lists of :data:`TOPS` as arrays of (label, n); whole distributions, which have no bound, are rows
    of :func:`graph_lists`. Repeated triples count as often as they stand; ``duplicate_triples`` tells how many are repeats."""
    if not per_graph:
        triples = triples.withColumn("graph", F.lit("*"))
    triples = settle(triples)
    terms = settle(_by_term(triples, "graph"))
    numbers = [c.alias(n) for n, c in _term_counts(base).items()]
    # Without triples there is still a row for all graphs together.
    counts = settle(terms.groupBy("graph").agg(*numbers) if per_graph else terms.agg(*numbers).withColumn("graph", F.lit("*")))
    twice = triples.groupBy("graph", "s_kind", "s", "p", "o", "o_kind", "o_dt", "o_lang").agg((F.count("*") - 1).alias("n"))
    twice = twice.groupBy("graph").agg(F.sum("n").alias("duplicate_triples"))
    marked = F.when(F.col("kind") == "bnode", F.concat(F.lit("_:"), "term")).otherwise(F.col("term"))
    nodes = terms.where(_resource()).select("graph", marked.alias("node"), (F.col("out") + F.col("in_")).alias("n"))
    edges = resource_edges(triples, "graph")
    sizes = components(edges, "graph", nodes, stored=True).groupBy("graph", "root").agg(F.count("*").alias("n")).groupBy("graph").agg(
        F.count("*").alias("components"), F.max("n").alias("largest_component"))
    far = distances(edges, counts.select("graph", "resource_nodes"), "graph", distance_limit).select(
        "graph", "largest_distance", F.col("computed").alias("largest_distance_computed"))
    lists = graph_lists(triples, base, True, terms).where(F.col("list").isin(*TOPS)).groupBy("graph").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == t, F.struct("place", "label", "n")))), lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n"))).alias(t)
        for t in TOPS])
    out = reduce(lambda a, b: a.join(b, "graph", "left"), [counts, twice, sizes, far, lists]).fillna(0, ["duplicate_triples", "components", "largest_component"])
    return out if per_graph else out.drop("graph")


def graph_terms(triples: DataFrame) -> DataFrame:
    own = terms(triples).where("kind <> 'lit'").groupBy("kind", "term").agg(F.lit(1).alias("one"))
    return own.agg(F.count_if(F.col("kind") == "iri").alias("iri_count"), F.count_if(F.col("kind") == "bnode").alias("blank_nodes"))


def literal_quality(triples: DataFrame) -> DataFrame:
    """Literals, untyped and empty ones, sameAs statements, and repeated triples."""
    once = triples.groupBy("s_kind", "s", "p", "o", "o_kind", "o_dt", "o_lang").agg(F.count("*").alias("n"))
    lit, n = F.col("o_kind") == "lit", F.col("n")
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    return once.agg(total(lit).alias("literals"), total(lit & F.col("o_dt").isNull() & F.col("o_lang").isNull()).alias("untyped"),
                    total(lit & (F.col("o") == "")).alias("empty"), total(F.col("p") == OWL + "sameAs").alias("same_as"),
                    F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicates"))


def triple_counts(triples: DataFrame) -> DataFrame:
    """(graph, n)."""
    return triples.groupBy("graph").agg(F.count("*").alias("n"))


def subject_stats(triples: DataFrame) -> DataFrame:
    per = triples.groupBy("s_kind", "s").agg(F.count("*").alias("n"))
    return per.agg(F.round(F.coalesce(F.sum("n") / F.count("*"), F.lit(0.0)), 6).alias("avg_triples_per_subject"),
                   F.count_if(F.col("n") == 1).alias("single_triple_subjects"))


def predicate_distribution(triples: DataFrame) -> DataFrame:
    """(label, n) of every predicate."""
    per = triples.groupBy("p").agg(F.count("*").alias("n"))
    return per.groupBy(term_label(F.col("p"), F.lit("iri")).alias("label")).agg(F.sum("n").alias("n"))


def top(counts: DataFrame, n: int = 10, rare: bool = False) -> DataFrame:
    """The n most frequent, or rarest, labels; ties by label."""
    return counts.orderBy(F.col("n").asc() if rare else F.col("n").desc(), "label").limit(n)


def class_counts(triples: DataFrame) -> DataFrame:
    typed = triples.where(F.col("p") == TYPE).groupBy("s_kind", "s", "o", "o_kind").agg(F.lit(1).alias("one"))
    labelled = typed.select("s_kind", "s", term_label(F.col("o"), F.col("o_kind")).alias("label")).distinct()
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def coverage(triples: DataFrame) -> DataFrame:
    per = triples.groupBy("s_kind", "s").agg(F.bool_or(F.col("p") == TYPE).alias("typed"), F.bool_or(F.col("p") == LABEL).alias("named"))
    n, typed, named = F.count("*"), F.count_if("typed"), F.count_if("named")
    return per.agg((n - typed).alias("without_type"), named.alias("with_label"), (n - named).alias("without_label"),
                   _share(typed, n).alias("type_coverage"), _share(named, n).alias("label_coverage"))


def literal_distribution(triples: DataFrame, column: str) -> DataFrame:
    """Literals by datatype (``o_dt``) or language (``o_lang``); ``None`` where there is none."""
    name = term_label(F.col(column), F.lit("iri")) if column == "o_dt" else F.col(column)
    per = triples.where("o_kind = 'lit'").groupBy(column).agg(F.count("*").alias("n"))
    return per.groupBy(F.coalesce(name, F.lit("None")).alias("label")).agg(F.sum("n").alias("n"))


def external_namespaces(triples: DataFrame, base: str) -> DataFrame:
    """(namespace, n): occurrences of IRIs outside ``base``, at any place."""
    per = terms(triples).where((F.col("kind") == "iri") & ~F.col("term").startswith(base)).groupBy("term").agg(F.count("*").alias("n"))
    return per.groupBy(namespace(F.col("term")).alias("label")).agg(F.sum("n").alias("n"))


def resource_edges(triples: DataFrame, by: str | None = None) -> DataFrame:
    """(by, s, o) between resources; blank nodes are told apart from IRIs by their mark."""
    mark = lambda c, k: F.when(F.col(k) == "bnode", F.concat(F.lit("_:"), F.col(c))).otherwise(F.col(c))
    return triples.where(_is_resource()).select(*([by] if by else []), mark("s", "s_kind").alias("s"), mark("o", "o_kind").alias("o"))


def resource_nodes(triples: DataFrame) -> DataFrame:
    """(node): every subject, and every object that is no literal."""
    mark = lambda c, k: F.when(F.col(k) == "bnode", F.concat(F.lit("_:"), F.col(c))).otherwise(F.col(c))
    both = F.array(mark("s", "s_kind"), F.when(_is_resource(), mark("o", "o_kind")))
    return triples.select(F.explode(both).alias("node")).where("node is not null").distinct()


def degrees(triples: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of every resource: one grouping, counts pre-added before the shuffle."""
    mark = lambda c, k: F.when(F.col(k) == "bnode", F.concat(F.lit("_:"), F.col(c))).otherwise(F.col(c))
    edge = _is_resource().cast("long")
    zero = F.lit(0).cast("long")
    ends = F.array(F.struct(mark("s", "s_kind").alias("node"), edge.alias("out"), zero.alias("in_")),
                   F.struct(F.when(_is_resource(), mark("o", "o_kind")).alias("node"), zero.alias("out"), edge.alias("in_")))
    rows = triples.select(F.explode(ends).alias("e")).select("e.*").where("node is not null")
    return rows.groupBy("node").agg(F.sum("out").alias("out_degree"), F.sum("in_").alias("in_degree"))


def degree_summary(triples: DataFrame) -> DataFrame:
    total = F.col("out_degree") + F.col("in_degree")
    n = F.count("*")
    return degrees(triples).agg(
        n.alias("resource_nodes"), F.count_if(F.col("node").startswith("_:")).alias("blank_nodes"),
        _share(F.count_if(F.col("node").startswith("_:")), n).alias("blank_percent"),
        F.round(F.sum("out_degree") / n, 6).alias("avg_out"), F.round(F.sum("in_degree") / n, 6).alias("avg_in"),
        F.count_if(total <= 1).alias("weakly_connected"))


def largest_distance(triples: DataFrame, limit: int = DISTANCE_LIMIT, per_graph: bool = False) -> DataFrame:
    """(largest_distance, computed, resource_nodes) of all graphs taken together, or (with graph) of each: the longest of the
    shortest undirected paths. Null and not computed above ``limit`` nodes."""
    if not per_graph:
        triples = triples.withColumn("graph", F.lit("*"))
    ends = F.array(F.struct(F.col("s_kind").alias("k"), F.col("s").alias("t")), F.when(_is_resource(), F.struct(F.col("o_kind").alias("k"), F.col("o").alias("t"))))
    nodes = triples.select("graph", F.explode(ends).alias("x")).where("x is not null").distinct()
    n = F.count("*").alias("resource_nodes")
    sizes = nodes.groupBy("graph").agg(n) if per_graph else nodes.agg(n).select(F.lit("*").alias("graph"), "resource_nodes")
    out = distances(resource_edges(triples, "graph"), sizes, "graph", limit)
    return out if per_graph else out.drop("graph")


def top_per_graph(counts: DataFrame, n: int = 3) -> DataFrame:
    """``counts`` (graph, label, n): the n most frequent of each graph, ties by label."""
    w = Window.partitionBy("graph").orderBy(F.col("n").desc(), "label")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
