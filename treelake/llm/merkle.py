"""A Merkle manifest of a dataset: a tree of digests for each language, and one over their roots.

Leaves are numbered in their group over sorted ranges. Aligned subtrees of ``2 ** HEIGHT`` leaves are
each built by one task call in one array in van Emde Boas layout: a tree of some height is cut at half of it, the top
comes first, then the bottoms from left to right, each laid out in the same way. Address arithmetic alone finds a
node, both for building and for reading siblings, and no node holds a pointer. The roots of the subtrees are the leaves of the next
round, until every group has one; a round divides the nodes by ``2 ** HEIGHT``. The way back needs a row per subtree only: the
siblings above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import crc32_sql, cut, exact_id, forget
from treelake.ranges import numbered

#: Levels of a subtree that one call builds; digests of a subtree of 2 ** 10 leaves take about 130 kB.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


@lru_cache(maxsize=64)
def addresses(height: int) -> list[list[int]]:
    """Place of node ``i`` of level ``k`` (0: leaves) of a full tree with ``height`` levels in the van Emde Boas layout."""
    if height == 1:
        return [[0]]
    low = height // 2
    high = height - low
    top, bottom = addresses(high), addresses(low)
    size_top, size_low = 2**high - 1, 2**low - 1
    out = []
    for k in range(low):
        width = 2 ** (low - 1 - k)
        out.append([size_top + (i // width) * size_low + bottom[k][i % width] for i in range(2 ** (height - 1 - k))])
    return out + top


class Subtree:
    """Digests of an aligned subtree with some leaves from the left, in one array in van Emde Boas layout.

    ``full``: the tree goes on above, so that a lone leftmost node still becomes the digest of itself on every level.
    Otherwise the tree ends where one node is left."""

    def __init__(self, leaves: list[str], height: int, full: bool):
        self.levels = height + 1 if full else max(len(leaves) - 1, 0).bit_length() + 1
        self.at = addresses(self.levels)
        self.widths = [-(-len(leaves) // 2**k) for k in range(self.levels)]
        self.cells: list[str] = [""] * (2**self.levels - 1)
        for i, leaf in enumerate(leaves):
            self.cells[self.at[0][i]] = leaf
        for k in range(1, self.levels):
            for i in range(self.widths[k]):
                own = [self.cells[self.at[k - 1][j]] for j in (2 * i, 2 * i + 1) if j < self.widths[k - 1]]
                self.cells[self.at[k][i]] = H(*own)

    @property
    def root(self) -> str:
        return self.cells[self.at[-1][0]]

    def siblings(self, i: int) -> list[tuple[bool, str]]:
        """Per level below the root: whether the sibling stands left, and its digest ('' if there is none)."""
        out = []
        for k in range(self.levels - 1):
            j = i ^ 1
            out.append((j < i, self.cells[self.at[k][j]] if j < self.widths[k] else ""))
            i >>= 1
        return out


def fold(leaf: str, path: str) -> str:
    """The root that ``leaf`` gives with the siblings of a written path."""
    for step in path.split(",") if path else ():
        leaf = H(step[1:], leaf) if step[0] == "L" else H(leaf, step[1:])
    return leaf


def written(steps: list[tuple[bool, str]]) -> str:
    return ",".join(("L" if left else "R") + digest for left, digest in steps)


def proof(path: str) -> str:
    return H(*[step[1:] for step in path.split(",")]) if path else H()


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole runs of rows with equal keys, of a partition sorted by them; null keys are equal."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        same = pd.concat([b[k].eq(b[k].shift()) | (b[k].isna() & b[k].shift().isna()) for k in keys], axis=1).all(axis=1)
        same.iloc[0] = bool(held) and all(
            (x == y) or (pd.isna(x) and pd.isna(y)) for x, y in ((held[-1][k].iloc[-1], b[k].iloc[0]) for k in keys))
        starts = [i for i, s in enumerate(same.to_numpy()) if not s]
        cuts = [0, *starts, len(b)]
        for n, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if n and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            if i < j:
                held.append(b.iloc[i:j])
    if held:
        yield pd.concat(held, ignore_index=True)


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes`` (grp, at, ...), blocks of ``2 ** height`` together in a task and in order."""
    return (nodes.withColumn("block", F.shiftright("at", height)).repartition("grp", "block")
            .sortWithinPartitions("grp", "block", "at"))


def forest(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Siblings of many trees at once. ``nodes``: grp (string or null), at (long, 0, 1, ... in its group), digest; further columns
    stay. Adds ``root`` and ``path``, the siblings from the node to the root as ``L`` or ``R`` and the digest, comma-joined."""
    rounds = [nodes]
    while True:
        own = rounds[-1]
        # A group with one block ends there; in another, every block has all levels.
        ends = own.groupBy("grp").agg((F.max("at") < 2**height).alias("last"))
        if ends.where(~F.col("last")).isEmpty():
            break
        rounds.append(cut(_roots(own, height)))
    above = None
    for own in reversed(rounds):
        above, done = _paths(own, above, height), above
        if own is not nodes:
            above = cut(above)
            forget(own)
    return above


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """Roots of the blocks of every group that has more than one."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(batches, ["grp", "block"]):
            tree = Subtree(run["digest"].tolist(), height, True)
            yield pd.DataFrame({"grp": [run["grp"].iloc[0]], "at": [run["block"].iloc[0]], "digest": [tree.root]})

    large = nodes.groupBy("grp").agg(F.max("at").alias("most")).where(F.col("most") >= 2**height).select(F.col("grp").alias("g"))
    rows = nodes.select("grp", "at", "digest").join(large, F.col("grp").eqNullSafe(F.col("g")), "left_semi")
    return _blocks(rows, height).mapInPandas(build, "grp string, at long, digest string")


def _paths(nodes: DataFrame, above: DataFrame | None, height: int) -> DataFrame:
    """``nodes`` with root and path; ``above`` (grp, at, root, path) has those of the blocks of larger groups."""
    rest = [c for c in nodes.columns if c not in ("grp", "at", "digest")]
    rows = _blocks(nodes, height)
    fields = [f.dataType.simpleString() for f in nodes.select(*rest).schema]
    schema = "grp string, at long, digest string, root string, path string" + "".join(f", `{c}` {t}" for c, t in zip(rest, fields))
    if above is None:
        rows = rows.withColumns({"above_root": F.lit(None).cast("string"), "above_path": F.lit(None).cast("string")})
    else:
        upper = above.select(F.col("grp").alias("g"), F.col("at").alias("b"), F.col("root").alias("above_root"), F.col("path").alias("above_path"))
        first = (F.col("at") == F.shiftleft("block", height)) & F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))
        # One row of a block carries what is above it, so that it isn't copied for each leaf.
        rows = (nodes.withColumn("block", F.shiftright("at", height)).join(upper, first, "left").drop("g", "b")
                .repartition("grp", "block").sortWithinPartitions("grp", "block", "at"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(batches, ["grp", "block"]):
            root, path = run["above_root"].iloc[0], run["above_path"].iloc[0]
            tree = Subtree(run["digest"].tolist(), height, isinstance(root, str))
            own = [written(tree.siblings(i)) for i in range(len(run))]
            tail = f",{path}" if isinstance(path, str) and path else ""
            yield run[["grp", "at", "digest"]].assign(
                root=root if isinstance(root, str) else tree.root, path=[(p + tail).strip(",") for p in own]).join(run[rest])

    return rows.mapInPandas(build, schema)


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified.

    Where ``tampered`` holds, the root is folded from a leaf whose n_chars is greater by one (a null stays null, and the
    leaf as it was). A null field counts as ``-``, a null language as a language of its own that comes first, a null doc_id
    before all others; rows with equal doc_id are ordered by their leaves, repeated rows are leaves of their own. The
    only leaf of a language is its subroot, the only subroot the root, and a proof without siblings is the digest of nothing. An
    empty table gives an empty result; other columns are ignored."""
    if tampered is None:
        tampered = F.lit(False)
    leaf = lambda n_chars: F.sha2(F.concat(*[_field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS]), 256)
    changed = F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("grp"), leaf(F.col("n_chars")).alias("digest"),
                       F.when(changed, leaf(F.col("n_chars") + 1)).alias("other"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    leaves = cut(numbered(rows, ["grp"], [F.col("doc_id").asc_nulls_first(), "digest"], "at").withColumn("id", exact_id("doc_id")).drop("doc_id"))
    trees = cut(forest(leaves, height))
    # Languages are nodes of the upper tree, in the order of their UTF-8 bytes (Spark's own order of strings).
    tops = trees.groupBy("grp").agg(F.first("root").alias("digest")).select(F.col("grp").alias("name"), "digest")
    tops = numbered(tops, [], [F.col("name").asc_nulls_first()], "at").select(F.lit("top").alias("grp"), "at", "digest", "name")
    upper = cut(forest(cut(tops), height)).select("name", F.col("root").alias("top_root"), F.col("path").alias("top_path"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = [",".join(filter(None, p)) for p in zip(b["path"], b["top_path"])]
            own = [o if isinstance(o, str) else d for o, d in zip(b["other"], b["digest"])]
            folded = [fold(d, p) for d, p in zip(own, paths)]
            yield pd.DataFrame({"doc_id": b["id"], "leaf": b["digest"], "subroot": b["root"], "root": b["top_root"],
                                "proof_sha256": [proof(p) for p in paths], "folded_root": folded,
                                "verified": [f == r for f, r in zip(folded, b["top_root"])]})

    found = trees.join(upper, F.col("grp").eqNullSafe(F.col("name")))
    out = found.select("id", "digest", "other", "root", "path", "top_root", "top_path").mapInPandas(
        check, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def tampered(id_col: str = "doc_id") -> Column:
    """The rows of the query's trial: those whose unsigned crc32 of the decimal id is divisible by 7."""
    return F.crc32(F.col(id_col).cast("string")) % 7 == 0


ORACLE = r"""
WITH RECURSIVE f AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS d, CAST(n_chars AS VARCHAR) AS n, CAST(n_chars + 1 AS VARCHAR) AS n1 FROM documents),
w AS (
  SELECT doc_id, lang, n_chars, d,
         coalesce(strlen(d) || ':' || d, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n) || ':' || n, '-') AS own, coalesce(strlen(n1) || ':' || n1, '-') AS other, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM f),
l AS (
  SELECT doc_id, lang, sha256(head || own || tail) AS leaf, sha256(head || other || tail) AS other,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || own || tail)) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id, coalesce(CRC_OF_D % 7 = 0, false) AS bad
  FROM w),
tree(grp, k, i, digest, n) AS (
  SELECT lang, 0, i, leaf, n FROM l
  UNION ALL
  SELECT grp, k, i, digest, n FROM (
    SELECT grp, k + 1 AS k, i // 2 AS i, sha256(digest || coalesce(lead(digest) OVER (PARTITION BY grp ORDER BY i), '')) AS digest, (n + 1) // 2 AS n, i % 2 AS odd
    FROM tree WHERE n > 1) WHERE odd = 0),
subroots AS (SELECT grp, digest, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top(k, i, digest, n) AS (
  SELECT 0, i, digest, n FROM subroots
  UNION ALL
  SELECT k, i, digest, n FROM (
    SELECT k + 1 AS k, i // 2 AS i, sha256(digest || coalesce(lead(digest) OVER (ORDER BY i), '')) AS digest, (n + 1) // 2 AS n, i % 2 AS odd
    FROM top WHERE n > 1) WHERE odd = 0),
steps AS (
  SELECT id, t.k AS step, xor(l.i >> t.k, 1) < (l.i >> t.k) AS is_left, coalesce(s.digest, '') AS digest
  FROM l JOIN (SELECT DISTINCT grp, k FROM tree WHERE n > 1) AS t ON t.grp IS NOT DISTINCT FROM l.lang
  LEFT JOIN tree AS s ON s.grp IS NOT DISTINCT FROM l.lang AND s.k = t.k AND s.i = xor(l.i >> t.k, 1)
  UNION ALL
  SELECT id, 1000 + t.k, xor(r.i >> t.k, 1) < (r.i >> t.k), coalesce(s.digest, '')
  FROM l JOIN subroots AS r ON r.grp IS NOT DISTINCT FROM l.lang JOIN (SELECT DISTINCT k FROM top WHERE n > 1) AS t ON true
  LEFT JOIN top AS s ON s.k = t.k AND s.i = xor(r.i >> t.k, 1)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step) AS pos FROM steps),
proofs AS (SELECT id, string_agg(digest, '' ORDER BY pos) AS p FROM ordered GROUP BY id),
folds(id, pos, now) AS (
  SELECT id, 0, CASE WHEN bad THEN other ELSE leaf END FROM l
  UNION ALL
  SELECT folds.id, CAST(o.pos AS INTEGER), sha256(CASE WHEN is_left THEN digest || now ELSE now || digest END) FROM folds JOIN ordered AS o ON o.id = folds.id AND o.pos = folds.pos + 1)
SELECT doc_id, leaf, r.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(p, '')) AS proof_sha256, now AS folded_root,
       now = (SELECT digest FROM top WHERE n = 1) AS verified
FROM l JOIN subroots AS r ON r.grp IS NOT DISTINCT FROM l.lang LEFT JOIN proofs USING (id)
JOIN (SELECT id, arg_max(now, pos) AS now FROM folds GROUP BY id) USING (id)
""".replace("CRC_OF_D", crc32_sql("d"))
