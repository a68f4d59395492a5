"""Shapes: constraints on nodes of a graph, with the inference of subclasses they need."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.lineage import by_predicate, settle
from treelake.model import RDFS, TYPE

SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = (RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range"))


@dataclass
class Property:
    """What the values of a path must be."""

    path: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    of_class: str | None = None
    node_kind: str | None = None
    node: Shape | None = None
    message: str | None = None


@dataclass
class Shape:
    """Focus nodes (of a class, given ones, or subjects of a predicate) and their constraints."""

    id: str
    target_class: str | None = None
    target_nodes: list[str] = field(default_factory=list)
    subjects_of: str | None = None
    properties: list[Property] = field(default_factory=list)
    not_exists: str | None = None
    message: str | None = None


def _transitive(pairs: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(a, b) closed under composition; the length of known paths doubles each round."""
    out = settle(pairs.select("a", "b").distinct())
    n = out.count()
    for _ in range(max_rounds):
        step = out.select("a", F.col("b").alias("via")).join(out.select(F.col("a").alias("via"), "b"), "via").select("a", "b")
        out = settle(out.union(step).distinct())
        if (now := out.count()) == n:
            return out
        n = now
    raise RuntimeError("the hierarchy is deeper than max_rounds doublings")


def rdfs_closure(triples: DataFrame, ontology: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """``triples`` with what subclasses, subproperties, domains and ranges imply: (s, p, o, o_kind) added. The
    closure runs on the ontology alone; it is broadcast up to ``max_broadcast`` pairs, joined by shuffle above."""
    pair = lambda p: ontology.where(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b"))
    small = lambda df: F.broadcast(df) if df.count() <= max_broadcast else df
    props, classes = _transitive(pair(SUBPROPERTY)), _transitive(pair(SUBCLASS))
    base = triples.select("s", "p", "o", "o_kind")
    wider = base.join(small(props), base["p"] == F.col("a")).select("s", F.col("b").alias("p"), "o", "o_kind")
    facts = base.unionByName(wider)
    domain, range_ = pair(DOMAIN), pair(RANGE)
    typed = facts.join(small(domain), facts["p"] == F.col("a")).select("s", F.lit(TYPE).alias("p"), F.col("b").alias("o"), F.lit("iri").alias("o_kind"))
    ranged = facts.where("o_kind <> 'lit'").join(small(range_), facts["p"] == F.col("a")).select(
        F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("b").alias("o"), F.lit("iri").alias("o_kind"))
    facts = facts.unionByName(typed).unionByName(ranged)
    up = facts.where(F.col("p") == TYPE)
    up = up.join(small(classes), up["o"] == F.col("a")).select("s", "p", F.col("b").alias("o"), "o_kind")
    return facts.unionByName(up).distinct()


def _focus(triples: DataFrame, shape: Shape) -> DataFrame:
    parts = []
    if shape.target_class:
        parts.append(triples.where((F.col("p") == TYPE) & (F.col("o") == shape.target_class)).select(F.col("s").alias("focus")))
    if shape.subjects_of:
        parts.append(triples.where(F.col("p") == shape.subjects_of).select(F.col("s").alias("focus")))
    if shape.target_nodes:
        parts.append(triples.sparkSession.createDataFrame([(n,) for n in shape.target_nodes], "focus string"))
    return reduce(lambda a, b: a.union(b), parts).distinct()


def _row(shape: Shape, path: str, value: Column, component: str, test: Column, message: str | None) -> Column:
    """A violation if ``test`` holds, else null."""
    said = F.lit(message or f"violates {component} of {path}")
    return F.when(test, F.struct(F.lit(shape.id).alias("shape"), F.col("focus"), F.lit(path).alias("path"), value.cast("string").alias("value"),
                                 F.lit(component).alias("component"), said.alias("message")))


def _reported(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*")


def _violations(triples: DataFrame, shape: Shape, focus: DataFrame) -> list[DataFrame]:
    """Violations of one shape: one grouping by focus node for all counts and absences, one pass over the values
    for what a value itself must be, and a join for each class or nested shape."""
    out, paths = [], [c.path for c in shape.properties]
    values = triples.where(F.col("p").isin(*paths)).select(F.col("s").alias("focus"), "p", "o", "o_kind", "o_dt").join(
        focus, "focus", "left_semi")
    counted = [c for c in shape.properties if c.min_count is not None or c.max_count is not None]
    if counted or shape.not_exists:
        looked = {c.path for c in counted} | ({shape.not_exists} if shape.not_exists else set())
        held = triples.where(F.col("p").isin(*sorted(looked))).select(F.col("s").alias("focus"), "p")
        # Focus nodes are marked by a row without predicate, so that those without a value are counted as well.
        both = held.unionByName(focus.select("focus", F.lit(None).cast("string").alias("p")))
        names = {p: f"n{i}" for i, p in enumerate(sorted(looked))}
        counts = both.groupBy("focus").agg(F.count_if(F.col("p").isNull()).alias("own"), *[
            F.count_if(F.col("p") == p).alias(n) for p, n in names.items()]).where("own > 0")
        rows = []
        for c in counted:
            n = F.col(names[c.path])
            if c.min_count is not None:
                rows.append(_row(shape, c.path, n, "minCount", n < c.min_count, c.message))
            if c.max_count is not None:
                rows.append(_row(shape, c.path, n, "maxCount", n > c.max_count, c.message))
        if shape.not_exists:
            rows.append(_row(shape, shape.not_exists, F.lit(None), "notExists", F.col(names[shape.not_exists]) > 0, shape.message))
        out.append(_reported(counts, rows))
    rows = []
    for c in shape.properties:
        own = F.col("p") == c.path
        if c.datatype:
            rows.append(_row(shape, c.path, F.col("o"), "datatype", own & ((F.col("o_kind") != "lit") | ~F.col("o_dt").eqNullSafe(c.datatype)), c.message))
        if c.node_kind:
            rows.append(_row(shape, c.path, F.col("o"), "nodeKind", own & (F.col("o_kind") != c.node_kind), c.message))
    if rows:
        out.append(_reported(values, rows))
    for c in shape.properties:
        at_path = values.where(F.col("p") == c.path)
        if c.of_class:
            members = triples.where((F.col("p") == TYPE) & (F.col("o") == c.of_class)).select(F.col("s").alias("o"))
            out.append(_reported(at_path.join(members, "o", "left_anti"), [_row(shape, c.path, F.col("o"), "class", F.lit(True), c.message)]))
        if c.node:
            nested = settle(at_path.select(F.col("o").alias("focus")).distinct())
            found = _violations(triples, c.node, nested)
            if found:
                bad = reduce(DataFrame.unionByName, found).select(F.col("focus").alias("o")).distinct()
                out.append(_reported(at_path.join(bad, "o", "left_semi"), [_row(shape, c.path, F.col("o"), "node", F.lit(True), c.message)]))
    return out


def _predicates(shape: Shape) -> set[str]:
    own = {c.path for c in shape.properties} | {p for p in (shape.subjects_of, shape.not_exists) if p}
    return own.union(*[_predicates(c.node) for c in shape.properties if c.node])


def validate(triples: DataFrame, shapes: list[Shape], ontology: DataFrame | None = None) -> DataFrame:
    """(shape, focus, path, value, component, message) of every violation; none means that the graph conforms.
    Subclasses count as their classes where an ontology is given. The triples that the shapes look at are computed once, by
    predicate, and the focus nodes of each shape once."""
    if ontology is not None:
        more = rdfs_closure(triples, ontology)
        triples = triples.select("s", "p", "o", "o_kind", "o_dt").unionByName(
            more.withColumn("o_dt", F.lit(None).cast("string")).join(triples.select("s", "p", "o", "o_kind"), ["s", "p", "o", "o_kind"], "left_anti"))
    needed = {TYPE}.union(*map(_predicates, shapes))
    triples = by_predicate(triples.where(F.col("p").isin(*sorted(needed))).select("s", "p", "o", "o_kind", "o_dt"))
    found = [x for s in shapes for x in _violations(triples, s, settle(_focus(triples, s)))]
    if not found:
        return triples.sparkSession.createDataFrame([], "shape string, focus string, path string, value string, component string, message string")
    return reduce(DataFrame.unionByName, found)


def conforms(violations: DataFrame) -> DataFrame:
    """One row: whether there is no violation."""
    return violations.limit(1).agg((F.count("*") == 0).alias("conforms"))


#: The vocabulary of reports.
SH = "http://www.w3.org/ns/shacl#"
_COMPONENTS = {"minCount": "MinCountConstraintComponent", "maxCount": "MaxCountConstraintComponent", "datatype": "DatatypeConstraintComponent", "class": "ClassConstraintComponent",
               "nodeKind": "NodeKindConstraintComponent", "node": "NodeConstraintComponent", "notExists": "SPARQLConstraintComponent"}


def report(violations: DataFrame, base: str = "urn:report:") -> DataFrame:
    """The violations as triples (s, p, o, o_kind, o_dt) of a validation report; a result is named by the digest of what it says. Without
    any there is only the report, which conforms. Violations are made distinct before they become triples, of which there are several each."""
    said = ["shape", "focus", "path", "value", "component"]
    violations = settle(violations.groupBy(*said).agg(F.collect_set(F.struct("message")).alias("messages")))
    name = F.concat(F.lit(base), F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("\u0002")) for c in said]), 256))
    parts = F.create_map(*[F.lit(x) for kv in _COMPONENTS.items() for x in kv])
    t = lambda s, p, o, kind="iri": F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))
    whole = F.lit(base + "all")
    iri = F.col("value").rlike("^(?:https?://|urn:)")
    rows = F.array(t(whole, SH + "result", name), t(name, TYPE, F.lit(SH + "ValidationResult")), t(name, SH + "focusNode", F.col("focus")), t(name, SH + "resultPath", F.col("path")),
                   t(name, SH + "sourceShape", F.col("shape"), "lit"),
                   t(name, SH + "sourceConstraintComponent", F.concat(F.lit(SH), F.element_at(parts, F.col("component")))),
                   t(name, SH + "resultSeverity", F.lit(SH + "Violation")), F.when(iri, t(name, SH + "value", F.col("value"))).when(F.col("value").isNotNull(), t(name, SH + "value", F.col("value"), "lit")))
    messages = F.transform("messages", lambda m: t(name, SH + "resultMessage", m["message"], "lit"))
    results = violations.select(F.explode(F.concat(F.filter(rows, lambda r: r.isNotNull()), messages)).alias("t")).select("t.*")
    head = conforms(violations).select(F.explode(F.array(
        t(whole, TYPE, F.lit(SH + "ValidationReport")), F.struct(whole.alias("s"), F.lit(SH + "conforms").alias("p"), F.col("conforms").cast("string").alias("o"), F.lit("lit").alias("o_kind"),
                                                                 F.lit("http://www.w3.org/2001/XMLSchema#boolean").alias("o_dt")))).alias("t")).select("t.*")
    return head.unionByName(results)


def validated_load(triples: DataFrame, shapes: list[Shape]) -> DataFrame:
    """The triples of those graphs that violate none of the shapes; each graph is checked by itself."""
    own = lambda c: F.concat_ws("\u0001", "graph", c)
    apart = (F.col("o_kind") == "lit") | (F.col("p") == TYPE)
    spread = triples.select(own("s").alias("s"), "p", F.when(apart, F.col("o")).otherwise(own("o")).alias("o"), "o_kind", "o_dt")
    bad = validate(spread, shapes).select(F.substring_index("focus", "\u0001", 1).alias("graph")).distinct()
    return triples.join(bad, "graph", "left_anti")
