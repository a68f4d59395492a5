"""Layout validation: a tree of specifications checked against every file at once.

The tree is a small configuration; all its filters are answered by one scan, and each of its levels by one grouping. Flags are
bits: 1 successful, 2 failed, 4 alternative taken, 8 wrong number, 16 optional.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.lineage import settle
from treelake.model import Catalogue
from treelake.operators.filters import KEY, find_all

FLAGS = {"SUCCESSFUL": 1, "FAILED": 2, "ALTERNATIVE": 4, "INVALID_NUMBER": 8, "OPTIONAL": 16}
_OPS = {"$eq": "=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


@dataclass
class Spec:
    """A filter with a rule for its hits below each target. ``n``: None (optional), a count, or {op: count}."""

    id: str
    flt: Any
    objfilter: str | None = None
    n: int | dict[str, int] | None = None
    recursive: bool = True
    rebase: bool = False
    alternatives: list[Spec] = field(default_factory=list)
    then: list[Spec] = field(default_factory=list)
    description: str = ""

    def __post_init__(self) -> None:
        rules = [("$eq", self.n)] if isinstance(self.n, int) else list((self.n or {}).items())
        for op, k in rules:
            if op not in _OPS or not isinstance(k, int) or k < (1 if isinstance(self.n, int) else 0):
                raise ValueError(f"n must be None, a count from 1, or an operator with a count: {self.n!r}")


def _holds(n: Any, count: Column) -> Column:
    rules = [("$eq", n)] if isinstance(n, int) else n.items()
    return reduce(lambda a, b: a & b, [{"$eq": count == k, "$gt": count > k, "$gte": count >= k, "$lt": count < k, "$lte": count <= k}[op]
                                       for op, k in rules])


def _filters(specs: list[Spec]) -> list[tuple[Any, str | None]]:
    """The filters of all specifications, their alternatives and what follows them, each once."""
    out: list[tuple[Any, str | None]] = []
    for spec in specs:
        for one in (spec, *spec.alternatives):
            if not any(f == one.flt and k == one.objfilter for f, k in out):
                out.append((one.flt, one.objfilter))
        out += [f for f in _filters(spec.then) if f not in out]
    return out


def _found(cat: Catalogue, filters: list[tuple[Any, str | None]]) -> DataFrame:
    """(file_id, target, name, direct, h0, h1, ...): every object that some filter hits, once for each object above it, with a
    flag for each filter. A hit meets its targets by its ancestors, never by a product."""
    names = [f"h{k}" for k in range(len(filters))]
    hits = find_all(cat, filters, names).where(reduce(lambda a, b: a | b, map(F.col, names))).where("name <> '/'")
    parts = F.filter(F.split("name", "/"), lambda x: x != "")
    above = F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.size(parts)),
                                                      lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    rows = hits.select("*", F.explode(above).alias("target")).where("target <> name")
    return rows.select("file_id", "target", "name", F.coalesce(F.col("parent") == F.col("target"), F.lit(False)).alias("direct"), *names)


def _level(found: DataFrame, filters: list, specs: list[Spec], targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of ``specs`` for ``targets`` (file_id, target, t0, t1, ...: which specification has it as target), and the
    hits that each of them uses (file_id, name, u0, u1, ...)."""
    at = lambda one: filters.index((one.flt, one.objfilter))
    hit = lambda k, spec, one: F.col(f"t{k}") & F.col(f"h{at(one)}") & (F.lit(True) if one.recursive else F.col("direct"))
    tries = [(k, j, spec, one) for k, spec in enumerate(specs) for j, one in enumerate((spec, *(spec.alternatives if spec.n is not None else ())))]
    rows = found.join(targets, ["file_id", "target"])
    counts = rows.groupBy("file_id", "target").agg(*[F.count_if(hit(k, spec, one)).alias(f"n{k}_{j}") for k, j, spec, one in tries])
    counts = settle(targets.join(counts, ["file_id", "target"], "left").fillna(0))
    results = []
    for k, spec in enumerate(specs):
        n, alternative = F.col(f"n{k}_0"), F.lit(0)
        if spec.n is None:
            flag = F.lit(FLAGS["SUCCESSFUL"] + FLAGS["OPTIONAL"])
        else:
            for j in range(1, len(spec.alternatives) + 1):
                alternative = F.when((n == 0) & (F.col(f"n{k}_{j}") > 0), FLAGS["ALTERNATIVE"]).otherwise(alternative)
                n = F.when(n == 0, F.col(f"n{k}_{j}")).otherwise(n)
            flag = F.when(_holds(spec.n, n), FLAGS["SUCCESSFUL"] + alternative).otherwise(FLAGS["FAILED"] + FLAGS["INVALID_NUMBER"] + alternative)
        results.append(F.when(F.col(f"t{k}"), F.struct(F.lit(spec.id).alias("spec"), n.cast("long").alias("n_hits"), flag.cast("int").alias("flag"),
                                                       F.lit(spec.description).alias("description"))))
    out = counts.select("file_id", "target", F.explode(F.filter(F.array(*results), lambda r: r.isNotNull())).alias("r")).select("file_id", "r.spec", "target", "r.n_hits", "r.flag", "r.description")
    if any(spec.alternatives and spec.then for spec in specs):
        rows = rows.join(counts.drop(*[f"t{k}" for k in range(len(specs))]), ["file_id", "target"])
    used = []
    for k, spec in enumerate(specs):
        test = hit(k, spec, spec)
        if spec.then and spec.n is not None:
            empty = F.lit(True)
            for j, other in enumerate(spec.alternatives, 1):
                empty = empty & (F.col(f"n{k}_{j - 1}") == 0)
                test = test | (empty & hit(k, spec, other))
        used.append(test.alias(f"u{k}"))
    return out, rows.select("file_id", "name", *used)


def validate(cat: Catalogue, specs: list[Spec]) -> DataFrame:
    """(file_id, spec, target, n_hits, flag, description): one row for each specification and target. Top-level
    ones have the root of every file as target; those in ``then`` every hit, so no hit means no row.

    The whole tree's filters are answered by one scan, which flags each object; each level of the tree is then one grouping of the
    flagged objects by target, for all of the level's specifications at once."""
    filters = _filters(specs)
    found = settle(_found(cat, filters))
    targets = cat.objects.where("name = '/'").select("file_id", F.col("name").alias("target"), *[F.lit(True).alias(f"t{k}") for k in range(len(specs))])
    out: list[DataFrame] = []
    while specs:
        results, used = _level(found, filters, specs, targets)
        out.append(results)
        below = [(k, sub) for k, spec in enumerate(specs) for sub in spec.then]
        specs = [sub for _, sub in below]
        if specs:
            rows = used.select("file_id", F.explode(F.array(*[F.struct(
                F.lit("/").alias("target") if sub.rebase else F.col("name").alias("target"), *[(F.col(f"u{k}") if m == i else F.lit(False)).alias(f"t{i}") for i in range(len(below))])
                for m, (k, sub) in enumerate(below)])).alias("x")).select("file_id", "x.*")
            targets = rows.where(reduce(lambda a, b: a | b, [F.col(f"t{i}") for i in range(len(below))])).groupBy("file_id", "target").agg(
                *[F.bool_or(f"t{i}").alias(f"t{i}") for i in range(len(below))])
    return reduce(lambda a, b: a.unionByName(b), out)


def flag_text(flag: Column) -> Column:
    return F.concat_ws("|", *[F.when(flag.bitwiseAND(bit) > 0, F.lit(name)) for name, bit in FLAGS.items()])


def summary(results: DataFrame) -> DataFrame:
    return results.withColumn("text", flag_text(F.col("flag")))


def failed(results: DataFrame) -> DataFrame:
    return results.where(F.col("flag").bitwiseAND(FLAGS["FAILED"]) > 0)


def is_valid(results: DataFrame) -> DataFrame:
    """(file_id, valid, n_failed)."""
    bad = F.col("flag").bitwiseAND(FLAGS["FAILED"]) > 0
    return results.groupBy("file_id").agg((~F.bool_or(bad)).alias("valid"), F.count_if(bad).alias("n_failed"))


__all__ = ["FLAGS", "KEY", "Spec", "failed", "flag_text", "is_valid", "summary", "validate"]
