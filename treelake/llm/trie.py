"""The prefix trie of conversations, built by a van Emde Boas recursion over depth.

A sequence of turns is cut at half its depth and the prefix up to the cut gets a name; the trie above the cut and the
forests below it are then independent and are cut in the same way. So the name of the prefix of ``j`` turns depends on two names only:
that of the prefix up to the last cut before ``j``, and that of the run of turns since; it takes log(depth) steps, not depth. Aligned
blocks of ``2 ** BITS`` turns are cut inside a task; the blocks' own names are the turns of the next round.

Totals go the other way: each forest below a cut is summed for its root, for all heights of cut at once,
and grafted onto the nodes between that root and the cut before it. Every pair of a node and one below it is parted by
exactly one cut, so each node meets its whole subtree once, in two groupings instead of one for each level.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import crc32_sql, cut
from treelake.ranges import PART, ROW, numbered, ranged
from treelake.skew import lookup

#: Turns of a block (as a power of 2) that one task call cuts; ids that are joined to one text at a time.
BITS, CHUNK = 10, 1 << 16
ROOT = sha256(b"root").digest()
_NONE = sha256(b"").hexdigest()
#: Most turns taken from the first conversation of a hundred, and how many conversations share it.
SHARED, GROUP = 6, 100


def _name(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).digest()


def prefix_names(items: list[bytes]) -> list[bytes]:
    """Names of the prefixes of 1, 2, ... ``items``."""
    n, out = len(items), [b""] * len(items)
    runs: dict[tuple[int, int], bytes] = {}

    def run(lo: int, size: int) -> bytes:
        if size == 1:
            return items[lo]
        if (lo, size) not in runs:
            runs[lo, size] = _name(run(lo, size // 2), run(lo + size // 2, size // 2))
        return runs[lo, size]

    def build(start: bytes, lo: int, size: int) -> None:
        """Names what lies strictly between the prefix ``start`` of ``lo`` turns and that of ``lo + size``."""
        half = size // 2
        if not half or lo >= n:
            return
        if lo + half <= n:
            out[lo + half - 1] = middle = _name(start, run(lo, half))
            build(middle, lo + half, half)
        build(start, lo, half)

    build(ROOT, 0, 2 << n.bit_length())
    return out


def _named_blocks(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Per turn of rows sorted by (conv_id, at): the names of the prefixes up to it and before it, inside its block."""
    key, items = None, []

    def flush() -> tuple[list[bytes], list[bytes | None]]:
        names = prefix_names(items)
        return names, [None, *names[:-1]]

    for b in batches:
        out: dict[str, list] = {"conv_id": [], "at": [], "local": [], "before": []}

        def emit() -> None:
            if items:
                names, before = flush()
                out["conv_id"] += [key[0]] * len(names)
                out["at"] += range(key[1] << bits, (key[1] << bits) + len(names))
                out["local"] += names
                out["before"] += before

        for conv, at, item in zip(b["conv_id"].tolist(), b["at"].tolist(), b["item"]):
            if (conv, at >> bits) != key:
                emit()
                key, items = (conv, at >> bits), []
            items.append(bytes(item))
        if out["conv_id"]:
            yield pd.DataFrame(out)
    if items:
        names, before = flush()
        yield pd.DataFrame({"conv_id": key[0], "at": range(key[1] << bits, (key[1] << bits) + len(names)), "local": names, "before": before})


def _hashed(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def named(turns: DataFrame, bits: int = BITS) -> DataFrame:
    """``turns`` (conv_id, at from 0 without gaps, item): conv_id, at, ``name`` of the prefix that ends there, and ``parent``."""
    block = F.shiftright("at", bits)
    sorted_ = turns.select("conv_id", "at", "item").repartition("conv_id", block).sortWithinPartitions("conv_id", "at")
    local = cut(sorted_.mapInPandas(lambda batches: _named_blocks(batches, bits), "conv_id long, at long, local binary, before binary"))
    ends_block = F.col("at").bitwiseAND(F.lit((1 << bits) - 1)) == (1 << bits) - 1
    blocks = local.where(ends_block).select("conv_id", F.shiftright("at", bits).alias("at"), F.col("local").alias("item"))
    if blocks.isEmpty():
        return local.select("conv_id", "at", F.col("local").alias("name"), F.coalesce("before", F.lit(ROOT)).alias("parent"))
    upper = cut(named(blocks, bits))
    over = lambda name, key: upper.select("conv_id", F.col("at").alias(key), F.col("name").alias(name))
    rows = (local.withColumn("last_block", block - 1).withColumn("own_block", F.when(ends_block, block))
            .join(over("start", "last_block"), ["conv_id", "last_block"], "left").join(over("whole", "own_block"), ["conv_id", "own_block"], "left"))
    below = lambda c: F.when(F.col("start").isNull(), F.col(c)).otherwise(_hashed(F.col("start"), F.col(c)))
    return rows.select("conv_id", "at", F.coalesce("whole", below("local")).alias("name"),
                       F.when(F.col("before").isNull(), F.coalesce("start", F.lit(ROOT))).otherwise(below("before")).alias("parent"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, at, item, size), and (conv_id, total) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("item"),
        F.char_length(text).cast("long").alias("size"))
    turns = cut(numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "item"], "at").drop("turn"))
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", shared)
    bases = lengths.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = cut(lengths.join(bases, "base", "left").withColumn("taken", taken)
                .withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    # A conversation may hold a large share of all turns.
    own = lookup(turns.where(F.col("at") >= shared), convs.select("conv_id", "h", "taken", "n"), "conv_id", "n")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "item", "size")
    first = turns.where((F.col("at") < SHARED) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    copied = (convs.where("taken > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken").cast("long") - 1)).alias("at"))
              .join(first, ["base", "at"]).select("conv_id", "at", "item", "size"))
    return cut(own.unionByName(copied)), convs.select("conv_id", "total")


def _digests(ends: DataFrame) -> DataFrame:
    """Per name the digest of its conv_ids in order. Ids are joined to texts of bounded length over sorted ranges; one
    digest is then a stream over its name's texts, which no task holds together."""
    placed = ranged(ends, ["name", "conv_id"])
    texts = (placed.groupBy("name", PART, F.floor(F.col(ROW) / CHUNK).alias("chunk"))
             .agg(F.concat_ws(",", F.array_sort(F.collect_list("conv_id")).cast("array<string>")).alias("ids")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            done = []
            for name, ids in zip(b["name"], b["ids"]):
                if bytes(name) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = bytes(name), sha256(ids.encode())
            yield pd.DataFrame(done, columns=["name", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["name", "ends_sha256"])

    return texts.repartition("name").sortWithinPartitions("name", PART, "chunk").mapInPandas(run, "name binary, ends_sha256 string")


def _grafted(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Sums of ``saved`` and ``leaves`` over what lies below each node (name, saved, leaves), nodes without any left out.
    ``nodes``: conv_id, depth, name, saved, leaves; ``steps``: conv_id, depth, name of every prefix of every conversation."""
    at = F.col("depth") - 1
    bits = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(at, F.lit(1)).cast("double"))).cast("int") + 1)
    parted = F.filter(bits, lambda k: F.call_function("shiftright", at, k) % 2 == 1)
    below = (nodes.where("depth > 1").withColumn("k", F.explode(parted))
             .select("conv_id", F.call_function("shiftleft", F.call_function("shiftright", at, F.col("k")), F.col("k")).alias("depth"),
                     F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k")).alias("half"), "saved", "leaves")
             .groupBy("conv_id", "depth", "half").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    forests = (below.join(steps, ["conv_id", "depth"]).groupBy("name", "half").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
               .join(nodes.select("name", "conv_id", "depth"), "name"))
    # The path from a forest's root up to the cut before it may be long: it is dealt to tasks in stretches.
    from_, to = F.col("depth") - F.col("half") + 1, F.col("depth")
    stretches = forests.select("conv_id", "saved", "leaves", to.alias("to"), F.explode(F.sequence(from_, to, F.lit(1 << BITS).cast("long"))).alias("from"))
    path = (stretches.repartition("conv_id", "from")
            .select("conv_id", "saved", "leaves", F.explode(F.sequence("from", F.least("to", F.col("from") + (1 << BITS) - 1))).alias("depth"))
            .groupBy("conv_id", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    return path.join(steps, ["conv_id", "depth"]).groupBy("name").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def prefix_trie(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (see the README for the rules).

    ``conversations``: conv_id (an integer), turn, role, text. Turns are ordered by turn, null first; turns with the same number by a digest of
    their role and text; repeated rows are turns of their own. Null roles and texts are empty. A row without conv_id belongs to no
    conversation and counts for nothing. An empty table gives an empty result (no member, no root); other columns are ignored."""
    turns, convs = rebuilt(conversations)
    prefixes = named(turns, bits).join(turns.select("conv_id", "at", "size"), ["conv_id", "at"])
    none = F.lit(None).cast("binary")
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"), none.alias("parent"), F.lit(0).cast("long").alias("size"))
    steps = cut(prefixes.select("conv_id", (F.col("at") + 1).alias("depth"), "name", "parent", "size").unionByName(top))

    nodes = steps.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"),
                                      F.min("parent").alias("parent"), F.min("size").alias("size"))
    nodes = cut(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).withColumn("leaves", (F.col("n_children") == 0).cast("long")))
    # A node may have any number of children.
    parents = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    above = lookup(nodes.where("depth > 0").select("name", "parent"), parents, "parent", "n_children").select("name", "parent_conv_id")
    sums = _grafted(nodes.select("conv_id", "depth", "name", "saved", "leaves"), steps.select("conv_id", "depth", "name"))
    total = nodes.where("depth > 0").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).select(F.lit(ROOT).alias("name"), "saved", "leaves")
    sums = sums.unionByName(total).select("name", F.col("saved").alias("saved_below"), F.col("leaves").alias("leaves_below"))
    ends = steps.join(convs.withColumnRenamed("total", "depth"), ["conv_id", "depth"], "left_semi").select("name", "conv_id")
    out = nodes.join(above, "name", "left").join(sums, "name", "left").join(_digests(ends), "name", "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("leaves_below", zero)).alias("n_leaves"),
                      (F.col("saved") + F.coalesce("saved_below", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, any_value(n) AS n, CRC % 6 AS h FROM (SELECT conv_id, n, CAST(conv_id AS VARCHAR) AS d FROM t) GROUP BY conv_id, d),
r AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
s AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS size, count(*) OVER (PARTITION BY conv_id) AS total,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS name
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c.conv_id, 0, 0, (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id), '' FROM c),
k AS (SELECT conv_id, depth, size, total, sha256(name) AS name, lag(sha256(name)) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM s),
nodes AS (
  SELECT name, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(CASE WHEN total = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM k GROUP BY name),
below AS (
  SELECT k.name, sum(u.saved) AS saved, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM nodes AS x WHERE x.parent = u.name)) AS leaves
  FROM nodes AS u JOIN k ON k.conv_id = u.conv_id AND k.depth <= u.depth GROUP BY k.name)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM nodes AS x WHERE x.parent = n.name) AS n_children,
       leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes AS n JOIN below AS b ON b.name = n.name LEFT JOIN nodes AS p ON p.name = n.parent
""".replace("CRC", crc32_sql("d"))
