"""Joins with hot keys; sets of long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.lineage import partitions, settle


#: Rows up to which a counted side is broadcast whole; its columns are few and short.
SMALL = 250_000


def lookup(rows: DataFrame, unique: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``unique``, which has one row per ``key`` and says in ``count`` how many of ``rows`` have it. Rows
    without a match are left out.

    A side of at most :data:`SMALL` rows is broadcast. Of a longer one the keys with more rows than an average partition, of which
    there are no more than partitions, are broadcast, so their rows stay where they are; only the others are shuffled, whatever size
    Spark takes either side for (of files it knows the compressed bytes, of an explode those before it)."""
    parts = partitions(rows.sparkSession)
    n, total = unique.agg(F.count("*"), F.coalesce(F.sum(count), F.lit(0))).first()
    if n <= SMALL:
        return rows.join(F.broadcast(unique.drop(count)), key)
    hot = F.col(count) * parts > total
    large = unique.where(hot).drop(count)
    near = rows.join(F.broadcast(large), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(unique.where(~hot).drop(count).hint("merge"), key)
    return near.unionByName(rest)


def distinct_rows(rows: DataFrame) -> DataFrame:
    """The set of ``rows``, which are computed once. Rows whose hash no other row has are in it as they are; only hashes are
    shuffled to find the others, which are made distinct in full. Above :data:`SMALL` hashes that repeat, all rows are."""
    names = rows.columns
    hashed = settle(rows.withColumn("__hash", F.xxhash64(*names)))
    again = settle(hashed.groupBy("__hash").agg(F.count("*").alias("n")).where("n > 1").select("__hash"))
    repeated, rows = again.count(), hashed.select(*names)
    if not repeated:
        return rows
    if repeated > SMALL:
        return rows.distinct()
    again = F.broadcast(again)
    once = hashed.join(again, "__hash", "left_anti").select(*names)
    return once.unionByName(hashed.join(again, "__hash", "left_semi").select(*names).distinct())
