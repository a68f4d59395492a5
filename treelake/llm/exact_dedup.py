"""Exact deduplication by a content sort, in DataFrame functions only.

Texts are equal when identical after every run of the six ASCII white-space characters became one
space. Sampled splitters range-partition the normalised texts by a bounded prefix and a 64-bit
key (so that the sample sent to the driver is small whatever the texts' length), Spark's external
sort brings equal texts next to each other, and each row is compared in full with the one before.

A text that holds more rows than an average partition would land in one task. Such texts are
counted first (at most ``P`` of them for ``P`` partitions, as each holds over 1/P of the rows), and
their rows are dealt to as many parts as they fill partitions; the parts' first rows, at most
``2 P``, are then compared in full among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.llm.common import cut, shuffle_partitions, text_of

#: A run of white space that is anything but one plain space.
_RUNS = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"
_PREFIX = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, _RUNS, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the smallest id is kept; a null id
    ranks after all others, and of rows that repeat the same id exactly one is kept. An empty
    table gives an empty result; other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_of(text_col)).alias("norm")).withColumn("key", F.xxhash64("norm"))
    return _grouped(rows, docs.count(), []).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns, whatever their names. Of rows that are equal in
    id and text but not in the rest, the one with the least hash of the whole row stays. The rows themselves are sorted, so a
    text is moved once."""
    norm = normalised(F.coalesce(F.col("whole")[text_col], F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    rows = rows.select(F.col("whole")[id_col].alias("doc_id"), "whole", F.xxhash64(norm).alias("key"), F.substring(norm, 1, _PREFIX).alias("head"))
    found = _grouped(rows, docs.count(), ["whole"], norm)
    return found.where("kept").select("whole.*")


def _grouped(rows: DataFrame, total: int, carried: list[str], norm: Column | None = None) -> DataFrame:
    """The groups of ``rows`` (doc_id, key, and either norm or head and what ``norm`` is made of) with the columns ``carried``."""
    parts = shuffle_partitions(rows.sparkSession)
    large = {r["key"]: r["n"] for r in rows.groupBy("key").agg(F.count("*").alias("n"))
             .where(F.col("n") * parts > max(total, 1) + parts).collect()}
    if norm is None:
        rows = rows.withColumn("head", F.substring("norm", 1, _PREFIX))
    by = ("head", "key")
    if large:
        split = F.create_map(*[F.lit(x).cast("long") for k, n in large.items() for x in (k, -(-n * parts // total))])
        salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.element_at(split, F.col("key"))), F.lit(0))
        rows = rows.withColumn("salt", salt.cast("int"))
        by = (*by, "salt")
    dealt = rows.repartitionByRange(*by)
    if norm is not None:
        dealt = dealt.withColumn("norm", norm)
    ties = [F.xxhash64(*carried)] if carried else []
    order = Window.partitionBy(*by).orderBy("norm", F.col("doc_id").asc_nulls_last(), *ties)
    first = ~F.lag("norm").over(order).eqNullSafe(F.col("norm"))
    seen = dealt.select(*by, "doc_id", "norm", *carried, first.alias("first"), F.row_number().over(order).alias("at"))
    run = F.max(F.when(F.col("first"), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = seen.withColumn("run", run)
    own = Window.partitionBy(*by, "run")
    found = runs.select(
        "doc_id", *carried, "first", F.sha2("norm", 256).alias("text_sha256"), F.col("key").isin(*large).alias("large"),
        F.when(F.col("first") & F.col("key").isin(*large), F.col("norm")).alias("part_text"),
        F.min("doc_id").over(own).alias("part_id"), F.count("*").over(own).alias("part_size"))
    if carried:  # only a part's first row can stay
        found = found.where("first")
    if not large:
        return found.select("doc_id", *carried, F.col("part_id").alias("keep_id"), F.col("part_size").alias("group_size"),
                            F.col("first").alias("kept"), "text_sha256")

    found = cut(found)
    merged = (found.where(F.col("part_text").isNotNull()).groupBy("part_text")
              .agg(F.min("part_id").alias("keep_id"), F.sum("part_size").alias("group_size"),
                   F.collect_list(F.struct("part_id", "text_sha256")).alias("parts"))
              .select("keep_id", "group_size", F.explode("parts").alias("p"))
              .select("keep_id", "group_size", F.col("p.part_id").alias("of"), F.col("p.text_sha256").alias("sha")))
    joined = found.join(F.broadcast(merged), found["large"] & found["part_id"].eqNullSafe(F.col("of"))
                        & (found["text_sha256"] == F.col("sha")), "left")
    keep = F.coalesce("keep_id", "part_id")
    return joined.select("doc_id", *carried, keep.alias("keep_id"),
                         F.coalesce("group_size", "part_size").alias("group_size"),
                         (F.col("first") & F.col("part_id").eqNullSafe(keep)).alias("kept"), "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
