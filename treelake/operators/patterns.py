"""Graph patterns as joins: basic patterns, optional and negated parts, paths, unions, construction.

Terms that begin with ``?`` are variables. Each pattern is one scan pruned to its predicate; patterns
join on the variables they share, in the order given (selective ones first).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.lineage import forget, settle

Pattern = tuple[str, str, str]
#: What makes two terms the same: literals differ by datatype and language.
TERM = ("o", "o_kind", "o_dt", "o_lang")


def match(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """One column per variable, named without the question mark."""
    tests, out = F.lit(True), {}
    for place, term in zip(("s", "p", "o"), pattern, strict=True):
        if term.startswith("?"):
            tests = tests & (F.col(out[term[1:]]) == F.col(place)) if term[1:] in out else tests
            out.setdefault(term[1:], place)
        else:
            tests = tests & (F.col(place) == term)
    return triples.where(tests).select(*[F.col(c).alias(v) for v, c in out.items()])


def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("patterns must share a variable")
    return left.join(right, shared, how)


def bgp(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    return reduce(join, [match(triples, p) for p in patterns])


def star(triples: DataFrame, subject: str, properties: dict[str, str]) -> DataFrame:
    """Single-valued properties of one subject in one grouping instead of one join each; all must be there."""
    rows = triples.where(F.col("p").isin(*properties.values()))
    out = rows.groupBy(F.col("s").alias(subject)).agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(v) for v, p in properties.items()])
    return out.dropna()


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return join(left, right, "left")


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    return join(left, right, "left_anti")


def having(left: DataFrame, right: DataFrame) -> DataFrame:
    return join(left, right, "left_semi")


def ask(df: DataFrame) -> DataFrame:
    """One row: whether there is any."""
    return df.limit(1).agg((F.count("*") > 0).alias("answer"))


def closure(edges: DataFrame, starts: DataFrame, both_ways: bool = False) -> DataFrame:
    """(start, node): all nodes that a path of (s, o) edges reaches from ``starts`` (start), themselves
    included. Each step joins the frontier with the edges and drops what was visited."""
    if both_ways:
        edges = edges.select("s", "o").union(edges.select(F.col("o"), F.col("s"))).distinct()
    edges = settle(edges.select("s", "o"))
    frontier = settle(starts.select("start", F.col("start").alias("node")).distinct())
    steps = [frontier]
    while True:
        step = frontier.join(edges, frontier["node"] == edges["s"]).select("start", F.col("o").alias("node")).distinct()
        seen = reduce(DataFrame.union, steps)
        frontier = settle(step.join(seen, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            forget(edges, frontier)
            return seen
        steps.append(frontier)


def below(objects: DataFrame, starts: DataFrame) -> DataFrame:
    """(file_id, start, name): all objects (file_id, name) at or below each of ``starts`` (file_id, start) in its file, by names alone: one
    join of the starts with the prefixes of the names, without rounds. The root ``/`` holds everything in its file."""
    parts = F.filter(F.split("name", "/"), lambda x: x != "")
    n = F.size(parts)
    above = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    rows = objects.select("file_id", "name", F.explode(F.concat(F.array(F.lit("/")), F.coalesce(above, F.array().cast("array<string>")))).alias("start"))
    return rows.join(starts.select("file_id", "start").distinct(), ["file_id", "start"]).select("file_id", "start", "name")


def union_graphs(*graphs: DataFrame) -> DataFrame:
    """A set of triples."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), graphs).dropDuplicates(["s", "p", *TERM])


def augment(triples: DataFrame, entities: DataFrame, external: DataFrame, excluded: list[str]) -> DataFrame:
    """Adds an external table's (entity, p, value) rows about ``entities`` (entity) found in the graph, but for
    excluded predicates; values that are addresses become IRIs."""
    rows = external.where(~F.col("p").isin(*excluded)).join(entities.select("entity").distinct(), "entity", "left_semi")
    none = F.lit(None).cast("string")
    new = rows.select(F.lit("external").alias("graph"), F.col("entity").alias("s"), F.lit("iri").alias("s_kind"), "p", F.col("value").alias("o"),
                      F.when(F.col("value").rlike("^https?://"), "iri").otherwise("lit").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    return union_graphs(triples, new)


def describe(triples: DataFrame, subjects: DataFrame, of_class: str | None = None, type_iri: str = "") -> DataFrame:
    """All triples of ``subjects`` (s), optionally of one class only."""
    if of_class:
        subjects = subjects.join(triples.where((F.col("p") == type_iri) & (F.col("o") == of_class)).select("s"), "s", "left_semi")
    return triples.join(subjects.select("s"), "s", "left_semi")


def construct(bindings: DataFrame, template: list[tuple[str | Column, str | Column, str | Column, str]]) -> DataFrame:
    """Triples (s, p, o, o_kind) from bindings; a template row with an unbound term gives none."""
    as_column = lambda x: x if isinstance(x, Column) else F.col(x[1:]) if x.startswith("?") else F.lit(x)
    rows = [F.struct(as_column(s).cast("string").alias("s"), as_column(p).cast("string").alias("p"), as_column(o).cast("string").alias("o"),
                     F.lit(k).alias("o_kind")) for s, p, o, k in template]
    out = bindings.select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    return out.where("s is not null and p is not null and o is not null").distinct()
