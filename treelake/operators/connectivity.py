"""Connected components of any size, and exact distances in graphs of bounded size, for many graphs at once.

Names are strings; rounds work on numbers, hashes of the names that are checked to differ. The names come back once, at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.lineage import forget, settle
from treelake.ranges import numbered
from treelake.skew import lookup

#: Nodes up to which a graph's distances are computed unless the caller says otherwise; one task holds such a graph.
DISTANCE_LIMIT = 2000


#: Nodes of the highest degree that are broadcast in the first step.
HUBS = 1000


def components(edges: DataFrame, by: str | None = None, nodes: DataFrame | None = None, max_rounds: int = 60, stored: bool = False) -> DataFrame:
    """(node, root): the connected components of (s, o) edges, root the least node; with ``by``, a column of the edges, those of each
    graph apart (by, node, root). ``nodes`` (by, node, n) adds nodes without edges and must then name all, once each; n is a node's degree.
    ``stored`` says that the edges are cheap to read again.

    First every node next to a hub takes its greatest hub's place and the edges are renamed and made distinct, which leaves few
    where many nodes share a hub. Then stars shrink: a round gives each node's greater neighbours its least neighbour, and then
    its smaller ones. Hubs cost their edges, which stay where they are while the hub's row is broadcast to them; long chains cost a
    logarithm of their length in rounds. Minima are taken before the shuffle, and no neighbourhood is ever gathered."""
    key = [by] if by else []
    edges = edges if stored else settle(edges)
    ends = edges.select(*key, F.explode(F.array("s", "o")).alias("node"), F.lit(1).alias("n")) if nodes is None else nodes
    names = settle(ends.groupBy(*key, "node").agg(F.sum("n").alias("n")).withColumn("id", _number(key, "node")))
    if names.groupBy("id").agg(F.count("*").alias("same")).where("same > 1").isEmpty():
        e = edges.where("s <> o").select(_number(key, "s").alias("a"), _number(key, "o").alias("b"))
    else:
        names = settle(numbered(names.drop("id"), [], [*key, "node"], "id"))
        end = lambda c, out: names.select(*key, F.col("node").alias(c), F.col("id").alias(out))
        e = settle(edges.where("s <> o").join(end("s", "a"), [*key, "s"]).join(end("o", "b"), [*key, "o"]).select("a", "b"))
    tops = names.orderBy(F.col("n").desc(), "id").limit(HUBS).select("id", F.monotonically_increasing_id().alias("place"))
    near, left = _hooked(e, settle(tops))
    e = stars(left.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), max_rounds)
    forget(*([] if stored else [edges]))
    # What is left of hubs and of nodes without one has its root; the rest has its hub's.
    above = F.broadcast(e.join(F.broadcast(near.select(F.col("hub").alias("u")).distinct()), "u").select(F.col("u").alias("hub"), "v"))
    e = e.union(near.join(above, "hub", "left").select("u", F.coalesce("v", "hub").alias("v")))
    rooted = names.join(e.select(F.col("u").alias("id"), "v"), "id", "left").select(*key, "node", F.coalesce("v", "id").alias("id"))
    labels = rooted.groupBy("id").agg(F.min("node").alias("root"), F.count("*").alias("n"))
    return lookup(rooted, labels, "id", "n").select(*key, "node", "root")


def _hooked(edges: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, hub): of each other node next to one of ``hubs`` (id, place; few rows) the first of them; and the ``edges`` (a, b) with such
    nodes replaced by it. Hubs are broadcast, so a key of what is shuffled has no more rows than the least of them."""
    at = lambda c: F.broadcast(hubs.select(F.col("id").alias(c), F.col("place").alias(f"{c}_place")))
    marked = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    one = F.col("a_place").isNull() != F.col("b_place").isNull()
    first = F.col("a_place").isNotNull()
    near = marked.where(one).select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"),
                                    F.coalesce("a_place", "b_place").alias("place"))
    near = settle(near.groupBy("u").agg(F.min_by("hub", "place").alias("hub")))

    def renamed(rows: DataFrame, c: str, other: str) -> DataFrame:
        rest = rows.where(F.col(f"{c}_place").isNull()).join(near.withColumnRenamed("u", c), c, "left").withColumn(c, F.coalesce("hub", c))
        out = rows.where(F.col(f"{c}_place").isNotNull()).select(c, *other.split()).union(rest.select(c, *other.split()))
        return out.where("a <> b").distinct()

    return near, renamed(renamed(marked, "a", "b b_place"), "b", "a").select("a", "b")


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) between numbered nodes, u > v, as one star per component: (u, v) with v the least node. Nodes without edges are
    not in it."""
    e = settle(edges.where("u <> v").distinct())
    for _ in range(max_rounds):
        # Done when every edge leads straight to a root.
        if e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return e
        near = settle(_neighbours(e))
        wide = settle(lookup(_both(e), near, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = settle(wide.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        # A node with one smaller neighbour has nothing to hand on.
        rest = lookup(wide, least.where("n > 1"), "u", "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, settle(rest.union(least.select("u", F.col("m").alias("v"))).distinct())
        forget(before, near, wide, least)
    raise RuntimeError("components did not settle")


def _number(key: list[str], name: str) -> Column:
    return F.xxhash64(*key, name)


def _both(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _neighbours(e: DataFrame) -> DataFrame:
    """Per node the least of itself and its neighbours, and how many it has."""
    return _both(e).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))


def diameter(s: np.ndarray, o: np.ndarray) -> int:
    """The longest of the shortest undirected paths between the ends of the edges, over all their components.

    A search from one node bounds the farthest distance of every other node of its component from both sides; a node whose upper bound is
    no more than the longest path found is never searched from."""
    names, ends = np.unique(np.concatenate([s, o]), return_inverse=True)
    a, b = ends[: len(s)], ends[len(s) :]
    n = len(names)
    start, to = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(start, kind="stable")
    to, first = to[order], np.searchsorted(start[order], np.arange(n + 1))
    degree = np.diff(first)
    low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max // 4)
    best, turn = 0, 0
    left = np.ones(n, bool)
    while left.any():
        own = np.flatnonzero(left)
        # In turn a node that may be far out and one that may be central.
        x = own[np.lexsort((-degree[own], -high[own] if turn % 2 == 0 else low[own]))[0]]
        turn += 1
        dist = np.full(n, -1)
        dist[x], step, front = 0, 0, np.array([x])
        while len(front):
            step += 1
            around = np.concatenate([to[first[i] : first[i + 1]] for i in front])
            front = np.unique(around[dist[around] < 0])
            dist[front] = step
        far = step - 1
        best = max(best, far)
        seen = dist >= 0
        low[seen] = np.maximum(low[seen], np.maximum(dist[seen], far - dist[seen]))
        high[seen] = np.minimum(high[seen], far + dist[seen])
        high[x] = far
        left &= high > best
        left[x] = False
    return int(best)


def distances(edges: DataFrame, sizes: DataFrame, by: str, limit: int = DISTANCE_LIMIT) -> DataFrame:
    """(by, resource_nodes, largest_distance, computed) of each graph in ``sizes`` (by, resource_nodes). A graph of more than ``limit`` nodes
    has no distance computed; another one is a task's, which holds at most ``limit`` squared edges."""
    sizes = settle(sizes)
    # A join by graph that is shuffled would put all edges of a large graph into one task, only to drop them.
    small = lookup(edges, sizes.select(by, "resource_nodes", (F.col("resource_nodes") <= limit).alias("small")), by, "resource_nodes").where("small")
    own = small.where("s <> o").select(by, F.least("s", "o").alias("s"), F.greatest("s", "o").alias("o")).distinct()
    kind = edges.schema[by].dataType.simpleString()

    def measure(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [key[0]], "longest": [diameter(rows["s"].to_numpy(str), rows["o"].to_numpy(str))]})

    found = own.groupBy(by).applyInPandas(measure, f"`{by}` {kind}, longest long")
    out = sizes.join(found, by, "left").withColumn("computed", F.col("resource_nodes") <= limit)
    return out.select(by, "resource_nodes", F.when(F.col("computed"), F.coalesce("longest", F.lit(0).cast("long"))).alias("largest_distance"), "computed")


__all__ = ["DISTANCE_LIMIT", "components", "diameter", "distances", "stars"]
