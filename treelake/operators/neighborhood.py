"""Parts of a graph around a node, a search hit, or the most connected nodes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.functions.paths import PREFIXES, namespace, term_label
from treelake.lineage import forget, settle
from treelake.model import LABEL, RDF, RDFS, OWL, TYPE
from treelake.skew import SMALL, distinct_rows


def edges(triples: DataFrame, with_terms: bool = True) -> DataFrame:
    """Distinct (s, o) between resources; ``with_terms=False`` leaves class membership and schema terms out."""
    out = triples.where("o_kind in ('iri', 'bnode')")
    if not with_terms:
        inside = [F.col("o").startswith(x) for x in (RDF, RDFS, OWL)]
        out = out.where((F.col("p") != TYPE) & ~(inside[0] | inside[1] | inside[2]))
    return out.select("s", "o").distinct()


def around(triples: DataFrame, focus: str, depth: int = 1, direction: str = "both", with_terms: bool = False) -> DataFrame:
    """Edges between the nodes within ``depth`` (1 or 2) steps of ``focus``, an IRI or a part of one or of a label; literals
    are no nodes."""
    if depth not in (1, 2) or direction not in ("both", "out", "in"):
        raise ValueError("depth is 1 or 2, direction is both, out or in")
    e = edges(triples, with_terms)
    out, back = e.select(F.col("s").alias("a"), F.col("o").alias("b")), e.select(F.col("o").alias("a"), F.col("s").alias("b"))
    steps = {"both": out.union(back), "out": out, "in": back}[direction]
    if "://" not in focus and triples.where(F.col("s") == focus).isEmpty():
        start = settle(matches(triples, focus))
    else:
        start = triples.sparkSession.createDataFrame([(focus,)], "node string")
    nodes = steps.join(start, steps["a"] == start["node"], "left_semi").select(F.col("b").alias("node")).union(start).distinct()
    if depth == 2:
        nodes = steps.join(nodes, steps["a"] == nodes["node"], "left_semi").select(F.col("b").alias("node")).union(nodes).distinct()
    return e.join(nodes, e["s"] == nodes["node"], "left_semi").join(nodes, e["o"] == nodes["node"], "left_semi")


def matches(triples: DataFrame, text: str) -> DataFrame:
    """(node): resources whose IRI or label contains ``text``, in any case."""
    has = lambda c: F.lower(c).contains(text.lower())
    hit = F.array(F.when(has("s") | ((F.col("p") == LABEL) & has("o")), F.col("s")), F.when((F.col("o_kind") != "lit") & has("o"), F.col("o")))
    return triples.select(F.explode(hit).alias("node")).where("node is not null").distinct()


def search(triples: DataFrame, text: str) -> DataFrame:
    """Edges (s, p, o) among the nodes whose IRI or label contains ``text``, in any case, and their neighbours."""
    hits = settle(matches(triples, text))
    e = settle(triples.where("o_kind in ('iri', 'bnode')").select("s", "p", "o").distinct())
    out = e.join(hits, e["s"] == hits["node"], "left_semi").select(F.col("o").alias("node"))
    back = e.join(hits, e["o"] == hits["node"], "left_semi").select(F.col("s").alias("node"))
    nodes = settle(hits.union(out).union(back).distinct())
    return e.join(nodes, e["s"] == nodes["node"], "left_semi").join(nodes, e["o"] == nodes["node"], "left_semi")


def node_table(triples: DataFrame, of: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(node, class, degree, shown, hidden) of the nodes in edges ``of``: the first class label by alphabet, and the
    neighbours inside and outside the edges ``shown``."""
    ends = lambda e: e.select(F.explode(F.array("s", "o")).alias("node"))
    degree = ends(of).groupBy("node").agg(F.count("*").alias("degree"))
    classes = triples.where(F.col("p") == TYPE).groupBy(F.col("s").alias("node")).agg(F.min(term_label(F.col("o"), F.col("o_kind"))).alias("class"))
    seen = ends(of if shown is None else shown).groupBy("node").agg(F.count("*").alias("shown"))
    out = degree.join(classes, "node", "left").join(seen, "node", "left").fillna({"class": "Resource", "shown": 0})
    return out.withColumn("hidden", F.col("degree") - F.col("shown"))


def most_connected(e: DataFrame, nodes: int = 1000, edges: int = 2000) -> DataFrame:
    """Edges among the ``nodes`` nodes of highest degree (ties by label and id), at most ``edges`` of them, with the
    totals and whether anything was left out."""
    degree = e.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    kept = degree.orderBy(F.col("degree").desc(), term_label(F.col("node"), F.lit("iri")), "node").limit(nodes).select("node")
    kept = F.broadcast(kept)
    inner = e.join(kept, e["s"] == kept["node"], "left_semi").join(kept, e["o"] == kept["node"], "left_semi")
    totals = degree.agg(F.count("*").alias("total_nodes")).join(e.agg(F.count("*").alias("total_edges")))
    found = inner.agg(F.count("*").alias("__inner"))
    # The one row of totals stays where no edge lies inside.
    out = totals.crossJoin(found).join(inner.orderBy("s", "o").limit(edges), F.lit(True), "left")
    cut = (F.col("total_nodes") > nodes) | (F.col("__inner") > edges)
    return out.select("s", "o", "total_nodes", "total_edges", cut.alias("truncated"))


#: Nodes and edges that a view shows at most, by its detail.
DETAIL: dict[str, tuple[int | None, int | None]] = {"compact": (250, 750), "balanced": (1000, 2000), "detailed": (2500, 8000), "full": (None, None)}


@dataclass
class View:
    """A part of a graph to look at: nodes (node, label, class, degree, shown, hidden), edges (s, p, o) and one row of totals."""

    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame


def _degrees(rows: DataFrame) -> DataFrame:
    """(node, kind, degree, label) of the nodes of ``rows``, which are a set of statements."""
    link = F.col("o_kind") != "lit"
    ends = F.array(F.struct(F.col("s").alias("node"), F.col("s_kind").alias("kind"), link.cast("long").alias("n")),
                   F.when(link, F.struct(F.col("o").alias("node"), F.col("o_kind").alias("kind"), F.lit(1).cast("long").alias("n"))))
    found = rows.select(F.explode(ends).alias("x")).where("x is not null").select("x.*").groupBy("node").agg(F.max("kind").alias("kind"), F.sum("n").alias("degree"))
    return found.withColumn("label", term_label(F.col("node"), F.col("kind")))


def _around_busiest(rows: DataFrame, most: int, isolated: bool) -> tuple[DataFrame, DataFrame]:
    """The set of the rows around each node that may be among the ``most`` of highest degree, and :func:`_degrees` of such nodes.

    Links counted by their ends' hashes, repeats and all, are no less than any degree behind a hash. Only nodes whose count reaches the
    least one that matters are named and counted exactly; where the last of them turns out to have fewer links, that is the next bound,
    and it holds."""
    link = F.col("o_kind") != "lit"
    ends = rows.where(link).select(F.explode(F.array(F.xxhash64("s"), F.xxhash64("o"))).alias("at"), F.lit(1).alias("n"))
    if isolated:
        ends = ends.union(rows.where(~link).select(F.xxhash64("s"), F.lit(0)))
    counts = settle(ends.groupBy("at").agg(F.sum("n").alias("n")))
    least = counts.orderBy(F.col("n").desc()).limit(most).agg(F.min("n")).first()[0] or 0
    while True:
        near = counts.where(F.col("n") >= least).select("at")
        if near.count() > SMALL:
            around = distinct_rows(rows)
            found = _degrees(around)
        else:
            a, b = (F.broadcast(near.withColumnRenamed("at", c)) for c in ("__a", "__b"))
            around = rows.join(a, F.xxhash64("s") == F.col("__a"), "left").join(b, F.when(link, F.xxhash64("o")) == F.col("__b"), "left")
            around = distinct_rows(around.where("__a is not null or __b is not null").select(*rows.columns))
            # Other nodes have only a part of their rows here.
            found = _degrees(around).join(F.broadcast(near), F.xxhash64("node") == F.col("at"), "left_semi")
        found = settle(found if isolated else found.where("degree > 0"))
        last = found.orderBy(F.col("degree").desc()).limit(most).agg(F.min("degree")).first()[0] or 0
        if last >= least:
            forget(counts)
            return around, found
        forget(found)
        least = last


def view(triples: DataFrame, detail: str = "balanced", isolated: bool = False, with_terms: bool = True) -> View:
    """The nodes of highest degree (ties by label and name) and the edges among them, as many as ``detail`` allows. Nodes without a
    shown edge are left out unless ``isolated``; a full view has no limits and leaves nothing out. Limits are of the view, not of the
    graph that it counts."""
    if detail not in DETAIL:
        raise ValueError(f"detail is one of {', '.join(DETAIL)}")
    most_nodes, most_edges = DETAIL[detail]
    isolated = isolated or detail == "full"
    rows = triples.select("s", "s_kind", "p", "o", "o_kind")
    if not with_terms:
        schema = lambda c: F.col(c).startswith(RDF) | F.col(c).startswith(RDFS) | F.col(c).startswith(OWL)
        rows = rows.where(~schema("s") & ~((F.col("o_kind") != "lit") & schema("o")))
    link = F.col("o_kind") != "lit"
    typed = triples.where(F.col("p") == TYPE)
    if most_nodes is None:
        rows = rows.distinct()
        kept = every = settle(_degrees(rows))
        few = kept.select("node")
    else:
        every = rows.select(F.explode(F.array("s", F.when(link, F.col("o"))) if isolated else F.array("s", "o")).alias("node"), link.alias("link"))
        every = every.where("node is not null" if isolated else "link").select("node").distinct()
        rows, found = _around_busiest(rows, most_nodes, isolated)
        kept = settle(found.orderBy(F.col("degree").desc(), "label", "node").limit(most_nodes))
        few = F.broadcast(kept.select("node"))
        typed = typed.join(few.withColumnRenamed("node", "s"), "s", "left_semi")
    inner = rows.where(link).select("s", "p", "o").join(few.withColumnRenamed("node", "s"), "s", "left_semi").join(few.withColumnRenamed("node", "o"), "o", "left_semi")
    inner = settle(inner.select("s", "p", "o"))
    shown = inner if most_edges is None else settle(inner.orderBy("s", "p", "o").limit(most_edges))
    seen = shown.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count("*").alias("shown"))
    classes = typed.groupBy(F.col("s").alias("node")).agg(F.min(term_label(F.col("o"), F.col("o_kind"))).alias("class"))
    nodes = kept.join(seen, "node", "left" if isolated else "inner").join(classes, "node", "left").fillna({"shown": 0, "class": "Resource"})
    nodes = nodes.select("node", "label", "class", "degree", "shown", (F.col("degree") - F.col("shown")).alias("hidden"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    # Each side is one row.
    totals = reduce(DataFrame.crossJoin, [one(every, "total_nodes"), one(nodes, "shown_nodes"), one(kept, "kept"), one(inner, "total_edges"), one(shown, "shown_edges")])
    summary = totals.select("total_nodes", "shown_nodes", "total_edges", "shown_edges", (F.col("kept") - F.col("shown_nodes")).alias("dropped_isolated"),
                            ((F.col("total_nodes") > F.col("kept")) | (F.col("total_edges") > F.col("shown_edges"))).alias("truncated"))
    return View(nodes, shown, summary)


def namespace_groups(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(group, namespace, nodes): the nodes by namespace, which is called by its bound prefix if it has one; blank nodes are a
    group of their own."""
    ends = F.array(F.struct(F.col("s_kind").alias("kind"), F.col("s").alias("node")), F.when(F.col("o_kind") != "lit", F.struct(F.col("o_kind").alias("kind"), F.col("o").alias("node"))))
    nodes = triples.select(F.explode(ends).alias("x")).where("x is not null").select("x.*").distinct()
    space = F.when(F.col("kind") == "bnode", "blank").otherwise(namespace(F.col("node")))
    bound = F.create_map(*[F.lit(x) for k, v in (PREFIXES if prefixes is None else prefixes).items() for x in (v, k)])
    return nodes.groupBy(space.alias("namespace")).agg(F.count("*").alias("nodes")).select(F.coalesce(F.element_at(bound, F.col("namespace")), "namespace").alias("group"), "namespace", "nodes")


def class_index(nodes: DataFrame) -> DataFrame:
    """(class, nodes, links, hidden) of a table of nodes: how many have each class, their neighbours, and those of them not shown."""
    return nodes.groupBy("class").agg(F.count("*").alias("nodes"), F.sum("degree").alias("links"), F.sum("hidden").alias("hidden"))
